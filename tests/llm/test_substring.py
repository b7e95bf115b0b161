"""Substring dedup against brute force: shards of few windows, salts, joins instead of a bitmap, clashing names, hostile words."""

import hashlib
import os
import random
import re

import pytest

from quadrille.llm import substring_dedup

R = random.Random(12)


def say(n):
    return [f"w{R.randrange(300)}" for _ in range(n)]


def brute(rows, window=50):
    split = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    first = {}
    for k, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(k, first.get(g, k))
    out = []
    for k, w in split:
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for p in range(i, i + window)}
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def texts():
    a, b, c = say(70), say(55), say(160)
    flips = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = flips.translate(str.maketrans("ab", "ba"))
    rows = [(1, None), (2, ""), (3, " \t"), (4, " ".join(a)), (5, " ".join(say(30) + a + say(20) + b)), (6, "\t".join(b + c)), (7, "  ".join(c[:100] + say(5) + c[60:])), (8, " ".join(a + a)), (9, " ".join(say(49))), (10, " ".join(c + c))]
    rows += [(11, " ".join([*b[:25], flips, *b[25:]])), (12, " ".join([*b[:25], other, *b[25:]])), (5, " ".join(a[:60])), (4, " ".join(a))]
    return rows + [(20 + k, " ".join(say(5) + c[20:90] + say(k))) for k in range(30)] + [(60, "x " * 120), (61, "x " * 80)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "one", k, "two") for k, t in texts_once]
    return spark.createDataFrame(rows, "doc_id bigint, text string, wanted string, gone int, row string")


texts_once = texts()


def test_report(docs):
    got = sorted(tuple(r) for r in substring_dedup.report(docs).collect())
    assert got == brute(texts_once) and sum(r[2] for r in got) > 2000


def test_small_shards_salts_and_joins(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 16)
    monkeypatch.setattr(substring_dedup, "SALT_WINDOWS", 64)
    want = sorted((r.doc_id, r.row, sorted(r.gone)) for r in substring_dedup.repeated(docs).collect())
    assert want and want == sorted((r.doc_id, r.row, sorted(r.gone)) for r in substring_dedup.repeated(docs, shard_windows=32, most_marks=0).collect())


def test_remove_keeps_other_columns(docs):
    got = substring_dedup.remove(docs)
    assert got.columns == docs.columns and got.count() == len(texts_once)
    assert substring_dedup.remove(docs.where("false")).collect() == [] == substring_dedup.report(docs.where("false")).collect()


def test_reference_of_its_own(spark, docs):
    spans = substring_dedup.against_reference(docs.where("doc_id = 5 and length(text) > 400"), docs.where("doc_id = 4")).collect()
    assert [(r.start, r.end) for r in spans] == [(30, 100)]
    with pytest.raises(ValueError):
        substring_dedup.against_reference(docs, docs, most_bytes=10)


def test_disk_is_given_back(spark, docs, monkeypatch):
    cut, made, joined = substring_dedup.cut, [], []
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    join = substring_dedup.keyed_join

    def watched(df):
        assert spark.conf.get(key) == "true"
        made.append(cut(df))
        return made[-1]

    def counted(left, *args, **kwargs):
        joined.append(left.count())
        return join(left, *args, **kwargs)

    monkeypatch.setattr(substring_dedup, "cut", watched)
    monkeypatch.setattr(substring_dedup, "keyed_join", counted)
    gone = substring_dedup.repeated(docs)
    assert gone.count() and spark.conf.get(key, None) == before
    assert len(joined) == substring_dedup.ROUNDS and max(joined) < 0.75 * sum(joined)
    there = [os.path.exists(f.removeprefix("file://")) for table in made for f in table.inputFiles()[:1]]
    assert sum(there) == 2  # the shared minimisers and the result
