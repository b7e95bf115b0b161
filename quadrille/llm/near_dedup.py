"""Operator 5: near-duplicate documents by SuperMinHash, banding, verification and union-find.

Documents with equal shingle sets form classes first, by partial aggregates.  One representative of
each class gets a SuperMinHash signature (ranks of one permutation per shingle, stopped once no later
rank can lower a minimum), whose bands make buckets.  Those of at most FEW members are compared pair by pair.  Members of a larger one are
compared with a leader; buckets of one leader are a group, and members of a group that aren't yet known to be
connected meet in tiles: a task has two tiles' sets, rules pairs out by a bound (``sketches``), confirms the others and
emits no more links than it has members.  Sets travel in rounds that hold half of what the table of sets
holds, whose shuffles go before the next, so disk doesn't grow with the number of pairs or leaders.  So no group is expanded into rows for its pairs, and no pair above
the threshold that shares a bucket stays apart.  Links are confirmed on full shingle sets, and
components grow by distributed minimum labels with pointer jumping.

With 32 bands of 4 of 128 values a pair at a similarity of 0.8 shares no bucket with a probability
of (1 - 0.8**4)**32 = 5e-8.

Defined results: a null or wordless text has no shingles, is linked with nothing and is kept; fewer
words than a shingle has make one shingle; very long texts are read whole; of rows of one doc_id with
different texts, the one whose set has the smallest digest stands for the document, and all get its
component; equally long or similar leaders are told apart by doc_id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import textops as X
from quadrille.llm.common import bitmap, cut, in_bitmap, keyed_join, map_rows, offsets_of, screened, table
from quadrille.ship import ship
from quadrille.tables import bucketed, discard, swept

SIZE, ROWS = 128, 4
#: Elements whose permutations are held at once: 256 bytes each.
BLOCK = 1 << 14
_GOLDEN = 0x9E3779B97F4A7C15
#: Members that are compared with one copy of their leader's set.
SALT_ROWS = 4096
#: Members of the buckets that are compared pair by pair, since a leader spares them little.
FEW = 12
#: Members and shingles (8 bytes each) a tile, and tiles that a larger group is dealt over: with more members tiles grow
#: instead, up to the bound on shingles, so that rows stay in proportion to members.
TILE, TILE_SHINGLES, TILES = 1024, 1 << 22, 16
#: Shingles (8 bytes each) that a round sends at least, if there are as many.
ROUND_SHINGLES = 1 << 23


def super_min_hash(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The SuperMinHash signature of a set of 64-bit hashes, all elements at once, rank by rank.

    Rank j of an element falls on the j-th place of its own permutation with the value j + uniform(0, 1).
    Once all places hold less than j + 1, later ranks change nothing, and the loop stops.
    """
    held = np.full(size, np.inf)
    for at in range(0, len(elements), BLOCK):
        _lower(held, elements[at : at + BLOCK])
    return held


def _lower(held: np.ndarray, elements: np.ndarray) -> None:
    """Lowers the minima by some elements; what is held already stops their ranks earlier."""
    size, n = len(held), len(elements)
    rows, places = np.arange(n), None
    for j in range(size):
        noise = X.mix(elements + X.U64((j + 1) * _GOLDEN % 2**64))
        value = (noise >> X.U64(11)).astype(np.float64) * 2.0**-53 + j
        pick = j + (X.mix(noise ^ X.U64(0xA5A5A5A5A5A5A5A5)) % X.U64(size - j)).astype(np.int64)
        if j == 0:
            place, first = pick, pick
        else:
            if places is None:
                places = np.tile(np.arange(size, dtype=np.int16), (n, 1))
                places[rows, first], places[rows, 0] = 0, first
            place = places[rows, pick].astype(np.int64)
            places[rows, pick] = places[rows, j]
            places[rows, j] = place
        np.minimum.at(held, place, value)
        if held.max() < j + 1:
            break


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; keys of different bands differ."""
    bits = signature.view(np.uint64).reshape(-1, rows)
    key = np.arange(len(bits), dtype=np.uint64) * X.U64(_GOLDEN)
    for k in range(rows):
        key = X.mix(key ^ bits[:, k])
    return key.view(np.int64)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted hashes; of fewer words, the whole sequence."""
    data, offs = X.buffers(texts)
    data = X.LOWER[data]
    starts, ends, word_offs = X.words(data, offs, X.NONSPACE)
    hashes = X.word_hashes(data, starts, ends)
    first, run_offs = X.starts_of_runs(word_offs, k)
    runs = X.run_hashes(hashes, k)[first] if len(first) else first
    out = []
    for i in range(len(texts)):
        a, b = word_offs[i], word_offs[i + 1]
        if b - a >= k:
            out.append(np.unique(runs[run_offs[i] : run_offs[i + 1]]))
        elif b > a:
            out.append(np.array([X.sequence_hash(hashes[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set, and the band keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text"), shingle)
        keys = [bands(super_min_hash(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
        return pa.record_batch(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _digests(sets), pa.ListArray.from_arrays(offsets_of([len(k) for k in keys]), pa.array(np.concatenate(keys) if keys else []).cast(pa.int64()))],
            names=["doc_id", "n_shingles", "set_hash", "bands"],
        )

    return map_rows(docs.select("doc_id", "text"), "text", run, "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles) of the wanted (doc_id, set_hash), one for each id; a bitmap of the ids spares the others' shingles.

    Hashes are compared by a range, which is no key of the join, so that the sets are dealt once, by doc_id.
    """
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("doc_id"), wanted.count()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        batch = batch.filter(pa.array(in_bitmap(ids, held.value)))
        if not batch.num_rows:
            return None
        sets = shingle_sets(batch.column("text"), shingle)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return pa.record_batch([batch.column("doc_id"), _digests(sets), pa.ListArray.from_arrays(offsets_of([len(s) for s in sets]), pa.array(flat))], names=["doc_id", "set_hash", "shingles"])

    rows = map_rows(docs.select("doc_id", "text"), "text", run, "doc_id bigint, set_hash binary, shingles array<bigint>")
    wanted = wanted.selectExpr("doc_id AS id", "set_hash AS one")
    return rows.join(wanted, F.expr("doc_id = id AND set_hash BETWEEN one AND one"), "left_semi").dropDuplicates(["doc_id"]).drop("set_hash")


def in_rounds(asked: DataFrame, keys: list[str], sets: DataFrame, order: list, run, schema: str) -> DataFrame:
    """``run`` over the rows of ``asked`` (keys, ..., doc_id, size) with their shingles, those of equal keys together.

    A round sends the rows of some keys: half as many shingles as ``sets`` holds, or ROUND_SHINGLES if that is more.
    ``sets`` is in buckets by doc_id, so that a round shuffles what it sends and not all sets besides.
    """
    asked = cut(asked)
    held = sets.agg(F.sum(F.size("shingles").cast("bigint"))).first()[0] or 0
    rounds = max(1, -(-(asked.agg(F.sum("size")).first()[0] or 0) // max(ROUND_SHINGLES, held // 2)))
    out = []
    for k in range(rounds):
        some = asked.where(F.pmod(F.xxhash64(*keys, F.lit(rounds)), F.lit(rounds)) == k).drop("size")
        rows = some.join(sets, "doc_id").select(*some.drop("doc_id").columns, "shingles")
        out.append(cut(rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, schema)))
    discard(asked)
    while len(out) > 1:
        out = [x.union(y) for x, y in zip(out[::2], out[1::2])] + out[len(out) & ~1 :]
    return out[0]


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b, company, size_a, size_b).

    Rows of a leader a are dealt over salts by ``company``, which bounds their number; each salt gets a's set once.
    """
    dealt = pairs.withColumn("salt", F.expr(f"pmod(xxhash64(b), 1 + company div {SALT_ROWS})"))
    leaders = dealt.selectExpr("a", "salt", "cast(null as bigint) AS b", "a AS doc_id", "size_a AS size").distinct()
    both = dealt.selectExpr("a", "salt", "b", "b AS doc_id", "size_b AS size").union(leaders)

    def run(batches):
        x = np.zeros(0, np.uint64)
        for batch in batches:
            linked = []
            flat, offs = batch.column("shingles").values.to_numpy().view(np.uint64), batch.column("shingles").offsets.to_numpy()
            for k, b in enumerate(batch.column("b").to_pylist()):
                y = flat[offs[k] : offs[k + 1]]
                if b is None:
                    x = y.copy()
                elif confirmed(x, [y], percent)[0]:
                    linked.append(k)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    ship(pairs.sparkSession)
    return in_rounds(both, ["a", "salt"], sets, ["a", "salt", F.col("b").asc_nulls_first()], run, "a bigint, b bigint")


def confirmed(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of other sets are linked with x; none is empty."""
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    found = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    common = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * common >= percent * (len(x) + sizes - common)


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """For each set and each of ``bits`` bins whether the bin holds an odd number of elements, 64 bins a number.

    Two sets' sketches differ in no more bins than there are elements in one of the sets only.
    """
    out = np.zeros((len(sets), bits // 64), np.uint64)
    step = max(1, (1 << 21) // bits)
    for at in range(0, len(sets), step):
        some = sets[at : at + step]
        row = np.repeat(np.arange(len(some)), [len(s) for s in some])
        count = np.bincount(row * bits + (np.concatenate(some) & X.U64(bits - 1)).astype(np.int64), minlength=len(some) * bits)
        out[at : at + step] = np.packbits((count & 1).astype(np.uint8).reshape(len(some), bits), axis=1).view(np.uint64)
    return out


def united(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different parts that connect what any links between them (of different sides, if given) connect.

    A linked pair has at most (100 - percent) / (100 + percent) * (|x| + |y|) elements in one of the two only, so
    pairs whose sketches differ in more bins aren't linked.  The others are confirmed unless connected by then.
    """
    up, down = 100 + percent, 100 - percent
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    part = np.unique(part, return_inverse=True)[1]
    ends = np.searchsorted(percent * size[order], 100 * size[order], "right")  # larger sets are too large
    bits = 1 << np.maximum(6, np.ceil(np.log2(4 * size[order])).astype(np.int64))
    links = []
    for m in np.unique(bits):
        first, last = np.searchsorted(bits, m), np.searchsorted(bits, m, "right")
        rows = order[first : ends[last - 1]]
        held, sizes = sketches([sets[r] for r in rows], int(m)), size[rows]
        for k in range(last - first):
            x, stop = rows[k], ends[first + k] - first
            open_ = part[rows[k + 1 : stop]] != part[x]
            if side is not None:
                open_ &= side[rows[k + 1 : stop]] != side[x]
            at = k + 1 + np.flatnonzero(open_)
            if not len(at):
                continue
            apart = np.bitwise_count(held[at] ^ held[k]).sum(axis=1, dtype=np.int64)
            near, step = rows[at[up * apart <= down * (sizes[at] + sizes[k])]], 1
            while len(near):
                some, near = near[:step], near[step:]
                for y in some[confirmed(sets[x], [sets[y] for y in some], percent)]:
                    if part[y] != part[x]:
                        links.append((x, y))
                        part[part == part[y]] = part[x]
                near = near[part[near] != part[x]]
                step = max(1, min(4 * step, (1 << 20) // len(sets[x])))
    return links


def tiled(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what links between different parts of groups (g, b, part, size) connect.

    Members of a group's largest part don't meet one another.  The others are dealt over tiles, and so are the largest
    part's; each of the others' tiles meets itself, each later one and each of the largest part's.
    """
    parts = groups.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    shape = parts.groupBy("g").agg(F.max(F.struct("n", "part", "w")).alias("m"), F.sum("n").alias("c"), F.sum("w").alias("w")).where("c > m.n")

    def tiles(n: str, w: str) -> str:
        return f"least({n}, greatest(least(ceil({n} / {TILE}), {TILES}), ceil({w} / {TILE_SHINGLES})))"

    shape = shape.selectExpr("g", "m.part AS main", f"{tiles('(c - m.n)', '(w - m.w)')} AS others", f"{tiles('m.n', 'm.w')} AS mains", "c")
    own = F.expr("if(part = main, others + pmod(xxhash64(b), mains), pmod(xxhash64(b), others))")
    each = keyed_join(groups.select("g", "b", "part", "size"), shape, ["g"], "c").withColumn("own", own)
    each = each.select("g", "b", "part", "size", "own", F.expr("explode(sequence(0, if(part = main, others, others + mains) - 1))").alias("other"))
    each = each.selectExpr("g", "least(own, other) AS i", "greatest(own, other) AS j", "b", "part", "own", "b AS doc_id", "size")

    def met(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        column = lambda name: np.concatenate([h.column(name).to_numpy() for h in held])
        members = []
        for h in held:
            flat, offs = h.column("shingles").values.to_numpy().view(np.uint64), h.column("shingles").offsets.to_numpy()
            members += [flat[offs[k] : offs[k + 1]] for k in range(h.num_rows)]
        first = held[0].slice(0, 1).to_pylist()[0]
        links = np.array(united(members, column("part"), None if first["i"] == first["j"] else column("own"), percent), np.int64).reshape(-1, 2)
        ids = column("b")[links]
        return pa.record_batch([pa.array(ids.min(axis=1)), pa.array(ids.max(axis=1))], names=["a", "b"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(name).to_numpy() for name in ("g", "i", "j")], axis=1)
            starts = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))), len(keys)]
            for at, end in zip(starts[:-1], starts[1:], strict=True):
                if at == end:
                    continue
                if held and key != (*keys[at],):
                    yield met(held)
                    held = []
                key = (*keys[at],)
                held.append(batch.slice(at, end - at))
        if held:
            yield met(held)

    ship(groups.sparkSession)
    return in_rounds(each, ["g", "i", "j"], sets, ["g", "i", "j"], run, "a bigint, b bigint")


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (b, part) with what new links (a, b) connect."""
    ends = links.join(label.selectExpr("b AS a", "part AS pa"), "a").join(label.selectExpr("b", "part AS pb"), "b").where("pa <> pb")
    new = components(ends.selectExpr("pa AS a", "pb AS b"))
    return cut(label.join(new.selectExpr("id AS part", "component"), "part", "left").select("b", F.coalesce("component", "part").alias("part")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of all ids in ``edges`` (a, b): the smallest id reachable.

    Union-find as tables: each round hooks every root to the smallest root beside it and then halves all
    paths; roots, not edges, decide when to stop, and only a count comes to the driver.
    """
    edges = cut(edges.select("a", "b").distinct())
    label = cut(edges.selectExpr("a AS id").union(edges.selectExpr("b AS id")).distinct().select("id", F.col("id").alias("component")))
    for _ in range(rounds):
        la, lb = label.selectExpr("id AS a", "component AS ca"), label.selectExpr("id AS b", "component AS cb")
        across = cut(edges.join(la, "a").join(lb, "b").where("ca <> cb").selectExpr("least(ca, cb) AS low", "greatest(ca, cb) AS high").distinct())
        if across.isEmpty():
            return label
        hook = across.groupBy("high").agg(F.min("low").alias("up"))
        hook = cut(hook)
        for _ in range(rounds):  # pointer jumping until every hook leads to a root
            jump = hook.join(hook.selectExpr("high AS up", "up AS next"), "up", "left").select("high", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
            jump = cut(jump)
            hook = jump.select("high", "up")
            if jump.where("moved").isEmpty():
                break
        label = cut(label.join(hook.withColumnRenamed("high", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component")))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def small_pairs(member: DataFrame) -> DataFrame:
    """(a, b): the pairs of each bucket of (key, b)."""
    each = member.groupBy("key").agg(F.sort_array(F.collect_set("b")).alias("all")).select("all").distinct()
    each = each.select(F.posexplode("all").alias("k", "a"), "all").where("k + 1 < size(all)")
    return each.select("a", F.expr("explode(slice(all, k + 2, size(all)))").alias("b")).distinct()


def led(member: DataFrame, company: DataFrame) -> DataFrame:
    """(a, b, company): beside each leader a the other members b of the buckets (key, b, c) that it leads.

    The leader is the member with most company: the text that copies were made from.
    """
    best = member.join(company, "b").groupBy("key").agg(F.max(F.struct("company", F.expr("-b AS minus"))).alias("m"), F.max("c").alias("c"))
    beside = keyed_join(member.select("key", "b"), best.selectExpr("key", "-m.minus AS a", "m.company AS company", "c"), ["key"], "c").where("a <> b")
    return beside.groupBy("a", "b").agg(F.max("company").alias("company"))


def connected(docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(b, part) of representatives (doc_id, n_shingles, set_hash, bands) that share a bucket: the smallest one reachable by links."""
    every = cut(reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("b")))
    sizes = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    member = cut(keyed_join(every, sizes, ["key"], "c"))
    discard(every)
    company = member.groupBy("b").agg(F.sum("c").alias("company"))
    company = cut(company.join(reps.selectExpr("doc_id AS b", "n_shingles AS size", "set_hash"), "b"))
    beside = cut(led(member.where(f"c > {FEW}"), company.select("b", "company")))
    pairs = small_pairs(member.where(f"c <= {FEW}")).join(company.selectExpr("b AS a", "company"), "a").select("a", "b", "company")
    pairs = pairs.union(beside).groupBy("a", "b").agg(F.max("company").alias("company"))
    pairs = pairs.join(company.selectExpr("b AS a", "size AS size_a"), "a").join(company.selectExpr("b", "size AS size_b"), "b")
    pairs = cut(pairs.where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"))  # no other pair is linked
    with bucketed(sets_of(docs, company.selectExpr("b AS doc_id", "set_hash"), shingle), "doc_id") as sets:
        links = cut(compare(pairs, sets, percent))
        label = joined(company.selectExpr("b", "b AS part"), links)
        groups = cut(beside.select(F.col("a").alias("g"), "b").join(label, "b").join(company.select("b", "size"), "b"))
        links = cut(tiled(groups, sets, percent))
    discard(member, company, beside, pairs, groups)
    return joined(label, links)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: n_shingles, component_id (the smallest doc_id reachable by links) and whether it is kept."""
    with swept(docs.sparkSession):
        return _near_duplicates(docs, shingle, percent)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    sig = cut(signatures(docs, shingle))
    several = cut(sig.where("n_shingles > 0").groupBy("doc_id").agg(F.min("set_hash").alias("one"), F.max("set_hash").alias("other")).where("one <> other").select("doc_id", "one"))
    if not several.isEmpty():
        sig = cut(sig.join(several, "doc_id", "left").withColumn("stands", F.expr("one is null or set_hash = one")).withColumn("set_hash", F.expr("if(n_shingles > 0, coalesce(one, set_hash), set_hash)")).drop("one"))
    else:
        sig = sig.withColumn("stands", F.lit(True))
    some = sig.where("n_shingles > 0 and stands")
    classes = cut(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))
    reps = cut(some.join(classes.select(F.col("rep").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"], "left_semi").select("doc_id", "n_shingles", "set_hash", "bands").dropDuplicates(["doc_id", "set_hash"]))
    label = connected(docs, reps, shingle, percent)
    discard(reps)
    whole = classes.join(label.selectExpr("b AS rep", "part"), "rep", "left").select("set_hash", F.coalesce("part", "rep").alias("component_id"), "c")
    return (
        keyed_join(sig.select("doc_id", "n_shingles", "set_hash"), whole, ["set_hash"], "c", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.expr("doc_id = component_id"))
    )


def keep(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, as they are; only those whose ids may be among the dropped are shuffled."""
    with swept(docs.sparkSession):
        gone = cut(near_duplicates(docs, shingle, percent).where("not kept").select("doc_id").distinct())
    some, rest = screened(docs, gone, gone.count())
    return some.join(gone, "doc_id", "left_anti").select(*docs.columns).union(rest)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k FROM s JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) USING (g)),
p AS (SELECT r.doc_id, g FROM r JOIN n USING (doc_id) WHERE k <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
e AS (SELECT a, b FROM (SELECT a, b, count(*) AS i FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(w.doc_id, coalesce(low, w.doc_id)) AS BIGINT) AS component_id, least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
