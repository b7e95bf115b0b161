"""Near-dedup: hubs, hot groups, words that a sum of powers confuses, rows of one doc_id that differ, empty tables."""

import random
import re
import threading
from pathlib import Path

import numpy as np

from quadrille.llm import near_dedup

R = random.Random(9)


def say(n, prefix="w"):
    return [f"{prefix}{R.randrange(10**9)}" for _ in range(n)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def run(spark, rows, k=4):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k).collect()}


def hub(groups, each):
    base = say(300)
    rows, tails = [(0, " ".join(base))], [say(100) for _ in range(groups)]
    for g in range(groups):
        rows += [(1 + g * each + k, " ".join([*base, *tails[g], *say(1)])) for k in range(each)]
    return rows


def test_a_hub_costs_pairs_in_proportion(spark, monkeypatch):
    counts, compare = [], near_dedup.compare

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return compare(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "compare", counted)
    rows = hub(3, 40)
    assert run(spark, rows) == brute(rows, 4)
    assert sum(counts) < 5 * len(rows)  # groups of 40 have 2,340 pairs


def test_chains_copies_and_words_that_sums_of_powers_confuse(spark):
    base = say(400)
    rows = [(k, " ".join(base[: 150 + 10 * k])) for k in range(26)] + [(100 + k, " ".join(base[6 * k : 330 + 6 * k])) for k in range(12)]
    rows += [(200 + k, " ".join([*base[:380], *say(3 * k)])) for k in range(30)]
    for c in range(4):
        base = say(80)
        for k in range(30):
            words = base[:]
            for _ in range(R.randrange(12)):
                words[R.randrange(len(words))] = say(1)[0]
            rows.append((1000 + c * 100 + k, " ".join(words[: R.randrange(60, 81)])))
    flips = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    rows += [(5000, flips), (5001, flips.translate(str.maketrans("ab", "ba"))), (5002, flips)]
    got = run(spark, rows)
    assert got == brute(rows, 4) and [got[5000 + k][2] for k in range(3)] == [True, True, False]


def edited(copies):
    """Copies of a text with words replaced by common ones: many are linked with none, but share what was put in."""
    base, put = say(150), say(6, "p")
    rows = []
    for k in range(copies):
        words = base[:]
        for _ in range(R.randrange(16)):
            words[R.randrange(150)] = put[R.randrange(6)]
        rows.append((k, " ".join(words)))
    return rows


def test_copies_linked_with_none_cost_rows_in_proportion(spark, monkeypatch):
    counts, compare = [], near_dedup.compare

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return compare(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "compare", counted)
    rows = edited(400)
    want = brute(rows, 4)
    assert len({part for _, part, _ in want.values()}) > 100
    assert run(spark, rows) == want
    assert len(counts) == 1 and counts[0] < 25 * len(rows)


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "TILE_SHINGLES", 4000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = edited(200)
    rows += [(k + 200, " ".join([*t.split(), *say(60, "x")])) for k, t in rows[:60]]
    try:
        assert run(spark, rows) == brute(rows, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_copies_of_copies_hold_disk_in_proportion_and_lose_no_link(spark, monkeypatch):
    rows = []
    for c in range(2):
        line = [say(300)]
        for _ in range(80):
            words = line[R.randrange(max(0, len(line) - 20), len(line))][:]
            for _ in range(R.randrange(1, 8)):
                words[R.randrange(300)] = say(1)[0]
            line.append(words)
        rows += [(1000 * c + k, " ".join(words)) for k, words in enumerate(line)]
    monkeypatch.setattr(near_dedup, "ROUND_SHINGLES", 1 << 10, raising=False)
    folders = [Path(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    folders.append(Path(spark.conf.get("spark.checkpoint.dir")))
    done, held = threading.Event(), []

    def files():
        for folder in folders:
            for file in folder.rglob("*"):
                try:
                    if file.is_file() and (file.suffix == ".parquet" or file.name.startswith("shuffle_")):
                        yield file, file.stat().st_size
                except OSError:  # a file may go meanwhile
                    pass

    def watch():
        while not done.wait(0.01):
            try:
                held.append(sum(size for file, size in files() if file not in before))
            except OSError:
                pass

    before = {file for file, _ in files()}
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = run(spark, rows)
    finally:
        done.set()
        watcher.join()
    assert got == brute(rows, 4)
    assert max(held) < 2 * sum(len(t) for _, t in rows), max(held) / sum(len(t) for _, t in rows)


def copies_of_copies(clusters):
    rows = []
    for c in range(clusters):
        line = [say(300)]
        for _ in range(40):
            words = line[R.randrange(max(0, len(line) - 20), len(line))][:]
            for _ in range(R.randrange(1, 8)):
                words[R.randrange(300)] = say(1)[0]
            line.append(words)
        rows += [(1000 * c + k, " ".join(words)) for k, words in enumerate(line)]
    return rows


def shuffled(spark, monkeypatch, run):
    """What ``run`` returns and the bytes that it shuffles, in rounds of few shingles and without broadcast joins."""
    monkeypatch.setattr(near_dedup, "ROUND_SHINGLES", 1 << 13)
    context = spark.sparkContext
    doubles = context._gateway.new_array(context._jvm.double, 0)

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        found = context._jsc.sc().statusStore().stageList(None, False, False, doubles, context._jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = max(stages(), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return out, sum(size for stage, size in stages().items() if stage > before)


def test_the_stage_shuffles_in_proportion_and_leaves_no_table(spark, monkeypatch):
    rows = copies_of_copies(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, sent = shuffled(spark, monkeypatch, lambda: {r.doc_id for r in near_dedup.keep(docs, 5).collect()})
    assert got == {i for i, (_, _, kept) in brute(rows, 5).items() if kept}
    assert sent < 6 * sum(len(t) for _, t in rows), sent / sum(len(t) for _, t in rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quadrille_")]


def test_op5_shuffles_in_proportion(spark, monkeypatch, tmp_path):
    rows = copies_of_copies(2)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, sent = shuffled(spark, monkeypatch, lambda: near_dedup.op5_near_dedup(spark, str(tmp_path)).collect())
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4)
    assert sent < 6 * sum(len(t) for _, t in rows), sent / sum(len(t) for _, t in rows)


def test_united_connects_what_all_pairs_do():
    rng = np.random.default_rng(5)
    for percent in (50, 80, 100):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool[: rng.integers(1, 30)], rng.integers(1, 40))) for _ in range(150)]
        sets += [np.unique(np.append(pool[: rng.integers(150, 400)], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64))) for _ in range(50)]
        part, side = rng.integers(0, 150, 200), rng.integers(0, 2, 200)
        for sides in (None, side):

            def groups(links):
                root = part.copy()
                for x, y in links:
                    root[root == root[x]] = root[y]
                return {frozenset(np.flatnonzero(root == r).tolist()) for r in root}

            some = near_dedup.united(sets, part, sides, percent)
            every = [(x, y) for x in range(200) for y in range(x) if sides is None or side[x] != side[y]]
            every = [(x, y) for x, y in every if 100 * len(np.intersect1d(sets[x], sets[y])) >= percent * len(np.union1d(sets[x], sets[y]))]
            assert groups(some) == groups(every) and len(some) < 200


def test_rows_of_one_id_that_differ(spark):
    one, two = " ".join(say(50)), " ".join(say(50))
    docs = spark.createDataFrame([(5, one), (5, two), (6, one), (7, two), (5, None)], "doc_id bigint, text string").coalesce(1)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(docs, 4).collect()}
    chosen = min((near_dedup._digests(near_dedup.shingle_sets(near_dedup.pa.array([t]), 4))[0].as_py(), i) for t, i in ((one, 6), (two, 7)))[1]
    assert got == {(5, 47): 5, (5, 0): 5, (6, 47): 5 if chosen == 6 else 6, (7, 47): 5 if chosen == 7 else 7}


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x", 2)], "doc_id bigint, text string, component_id string, b int")
    assert near_dedup.keep(docs).collect() == docs.collect()
    assert near_dedup.near_duplicates(docs.where("false")).collect() == []
