"""Operator 4: removal of passages that an earlier document has, by suffix automata of reference shards.

A reference shard is a bounded number of words in one suffix automaton.  Documents stream through it for
matching statistics: the longest match that ends at each word; where it is at least a window long, the
window is one of the reference's, word by word.  Two forms share this.

``against_reference`` takes a reference of its own, whose size is checked, and broadcasts its shards.

``repeated`` takes the corpus itself.  Its reference is what may repeat: windows whose minimiser (their
smallest hash of 25 consecutive words) is in two documents meet by 128-bit hashes, which name the smallest
doc_id of each by partial aggregates.  Stretches of such windows in that document are the reference
passages; they are dealt over shards by hash, and each document's stretches go to the shards of the passages
they may match.  A shard's automaton is built in the task that needs it, as often as its stretches are
salted, and decides.  No window is compared with another, and no task holds more than one automaton.
Windows look up their first document in ROUNDS rounds; shuffle files go when a query ends, tables once
nothing reads them.

Shared minimisers are looked up in a bitmap of bounded size; where there are too many for it, a join does
the same.

Defined results: a null or blank text has no words and keeps the empty string; texts shorter than a
window keep everything; very long texts are read whole; repeated rows of one doc_id never remove each
other, and where such rows differ, each loses its own windows; an empty table gives no rows; ties can't
arise; other columns are ignored by ``report`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import textops as X
from quadrille.llm.automaton import SuffixAutomaton
from quadrille.llm.common import HOT_KEYS, MOST_BITS, bitmap, cut, give_back, in_bitmap, keyed_join, map_rows, offsets_of, screened, table, unused
from quadrille.tables import discard, swept

#: Words of a window.
WINDOW = 50
#: Bytes of reference text in one automaton that is broadcast.
SHARD_BYTES = 4 << 20
#: Windows of reference passages in one automaton that a task builds, and of stretches that one such automaton reads, about.
SHARD_WINDOWS, SALT_WINDOWS = 1 << 16, 1 << 20
#: Windows look up their first document in this many rounds, of which each shuffles its share of them.
ROUNDS = 2
#: Passages are dealt over shards in pieces of this many windows, so that a long one doesn't make a long shard.
CHUNK = 1 << 12

REPORT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _read(texts: pa.Array):
    data, offs = X.buffers(texts)
    starts, ends, word_offs = X.words(data, offs, X.NONSPACE)
    return data, starts, ends, word_offs, X.word_hashes(data, starts, ends)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _minimisers(hashes: np.ndarray, word_offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows in document order: first word, minimiser; and each document's first window."""
    k = (window + 1) // 2
    first, run_offs = X.starts_of_runs(word_offs, window)
    if not len(first):
        return first, np.zeros(0, np.uint64), run_offs
    return first, _sliding_min(X.run_hashes(hashes, k), window - k + 1)[first], run_offs


def _listed(doc_ids: pa.Array, values: np.ndarray, docs: np.ndarray, name: str) -> pa.RecordBatch:
    """Rows (doc_id, value) of values that belong to document numbers."""
    return pa.record_batch([doc_ids.take(pa.array(docs)), pa.array(values.view(np.int64))], names=["doc_id", name])


def _distinct(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    return values[new], docs[new]


def _grouped_isin(values: np.ndarray, docs: np.ndarray, wanted: pa.ListArray) -> np.ndarray:
    """Which values are in their document's list."""
    out = np.zeros(len(values), bool)
    edges = np.searchsorted(docs, np.arange(len(wanted) + 1))
    for k in range(len(wanted)):
        if wanted[k].is_valid and len(mine := wanted[k].values):
            a, b = edges[k], edges[k + 1]
            out[a:b] = np.isin(values[a:b], mine.to_numpy().view(np.uint64))
    return out


def candidates(docs: DataFrame, window: int = WINDOW, most_marks: int = MOST_BITS // 8) -> DataFrame:
    """(doc_id, row, run, h1, h2, said): runs of windows that may start in two documents, from word number run: their hashes, and all their words."""

    def marks(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, _, word_offs, hashes = _read(batch.column("text"))
        _, low, run_offs = _minimisers(hashes, word_offs, window)
        number = np.repeat(np.arange(batch.num_rows), np.diff(run_offs))
        return _listed(batch.column("doc_id"), *_distinct(low, number), "mark")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, starts, ends, word_offs, hashes = _read(batch.column("text"))
        first, low, run_offs = _minimisers(hashes, word_offs, window)
        number = np.repeat(np.arange(batch.num_rows), np.diff(run_offs))
        some = np.flatnonzero(in_bitmap(low, held.value) if held else _grouped_isin(low, number, batch.column("marks")))
        if not len(some):
            return None
        one, two = X.run_hashes(hashes, window), X.run_hashes(X.mix(hashes ^ X.U64(0x5851F42D4C957F2D)), window)
        at, doc = first[some], number[some]
        begin = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(doc) != 0)]))
        counts = np.diff(np.append(begin, len(at)))
        said = [b" ".join(X.spelled(data, starts[a : a + n + window - 1], ends[a : a + n + window - 1])) for a, n in zip(at[begin].tolist(), counts.tolist(), strict=True)]
        ids, offs = batch.select(["doc_id", "row"]).take(pa.array(doc[begin])), offsets_of(counts)
        lists = [pa.ListArray.from_arrays(offs, pa.array(x[at].view(np.int64))) for x in (one, two)]
        return pa.record_batch([*ids.columns, pa.array(at[begin] - word_offs[doc[begin]]), *lists, pa.array(said, pa.binary())], names=["doc_id", "row", "run", "h1", "h2", "said"])

    docs = docs.select("doc_id", "text").where("doc_id is not null")
    marked = map_rows(docs, "text", marks, "doc_id bigint, mark bigint")
    shared = cut(marked.groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c")).where("low < high").select("mark", "c"))
    count = shared.count()
    held = docs.sparkSession.sparkContext.broadcast(bitmap(shared.select("mark"), count)) if count <= most_marks else None
    asked = docs
    if not held:
        lists = keyed_join(marked, shared, ["mark"], "c", ready=True).groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))
        asked = docs.join(lists, "doc_id")
    return map_rows(asked.withColumn("row", F.xxhash64("text")), "text", windows, "doc_id bigint, row bigint, run bigint, h1 array<bigint>, h2 array<bigint>, said binary")


def repeated(docs: DataFrame, window: int = WINDOW, most_marks: int = MOST_BITS // 8, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """(doc_id, row, gone): first words of windows that also start in a document with a smaller doc_id; row is the text's hash."""
    with swept(docs.sparkSession):
        found = cut(candidates(docs, window, most_marks))
        ids = found.withColumn("id", F.xxhash64("doc_id", "row", "run"))  # runs that share one by chance get each other's hits, which the automata refuse
        each = ids.select("doc_id", "id", "run", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).selectExpr("doc_id", "id", "run + at AS at", "h.h1", "h.h2")
        first = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("at").alias("place"), F.count("*").alias("c"))
        first = cut(first.where("low < high").select("h1", "h2", "low", "place", "c"))
        count = max(1, -(-first.count() // shard_windows))
        hits = []
        for k in range(ROUNDS):
            share = F.pmod("h1", F.lit(ROUNDS)) == k
            hit = keyed_join(each.where(share), first.where(share), ["h1", "h2"], "c", ready=True).withColumn("own", F.expr("doc_id = low"))
            hits.append(cut(hit.select("id", "at", "own", F.expr(f"pmod(xxhash64(low, place div {CHUNK}), {count})").alias("shard"))))
        discard(first)
        hit = reduce(DataFrame.union, hits)
        # A row for each of the heaviest automata only; any other has less than a HOT_KEYS-th of all windows to read.
        loads = hit.where("not own").groupBy("shard").count().where(F.col("count") > SALT_WINDOWS).orderBy(F.desc("count"), "shard").limit(HOT_KEYS).collect()
        salts = docs.sparkSession.sparkContext.broadcast({r.shard: 1 + r["count"] // SALT_WINDOWS for r in loads})
        per = hit.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("shard", "own", "at"))).alias("hits"))
        pieces = map_rows(ids.drop("h1", "h2").join(per, "id"), "said", lambda batch: _pieces(batch, window, salts.value), "shard bigint, salt bigint, own boolean, doc_id bigint, row bigint, at bigint, said binary")
        dealt = pieces.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.desc("own"), "doc_id", "row", "at")
        gone = dealt.mapInArrow(lambda batches: _decided(batches, window), "doc_id bigint, row bigint, at bigint")
        gone = cut(gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone")))
        discard(found, *hits)
    return gone


def _pieces(batch: pa.RecordBatch, window: int, salts: dict[int, int]) -> pa.RecordBatch:
    """Passages (own) and stretches of runs, cut where the shard changes; passages go to every salt of their shard."""
    out: list[tuple] = []
    hits, offs = batch.column("hits"), batch.column("hits").offsets.to_numpy()
    shard, own, at = (f.to_numpy(zero_copy_only=False) for f in hits.values.flatten())
    number = np.repeat(np.arange(len(hits)), np.diff(offs))
    shard, own, at = (x[offs[0] : offs[-1]] for x in (shard, own, at))
    same = np.zeros(len(at), bool)
    same[1:] = (number[1:] == number[:-1]) & (shard[1:] == shard[:-1]) & (own[1:] == own[:-1])
    new = ~same
    new[1:] |= at[1:] > at[:-1] + 1  # a repeated row's hits come twice
    begin = np.flatnonzero(new)
    last = at[np.append(begin[1:], len(at)) - 1]
    ids, rows, runs, texts = (batch.column(c).to_pylist() for c in ("doc_id", "row", "run", "said"))
    said, split = -1, []
    for k, s, o, a, z in zip(number[begin].tolist(), shard[begin].tolist(), own[begin].tolist(), at[begin].tolist(), last.tolist(), strict=True):
        if k != said:
            said, split = k, texts[k].split(b" ")
        if a < runs[k] or z - runs[k] + window > len(split):
            continue  # a hit of another run
        text = b" ".join(split[a - runs[k] : z - runs[k] + window])
        many = salts.get(s, 1)
        for salt in range(many) if o else [hash((ids[k], rows[k])) % many]:
            out.append((s, salt, o, ids[k], rows[k], a, text))
    columns = zip(*out, strict=True) if out else [()] * 7
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "salt", "own", "doc_id", "row", "at", "said"])


class Reference:
    """The automaton of some passages, and the document of each of their windows."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int) -> None:
        self.window, self.auto, self.symbols = window, SuffixAutomaton(), {}
        states = [(doc, self.auto.add([self.symbols.setdefault(w, len(self.symbols)) for w in said.split(b" ")])) for doc, said in passages]
        #: state of a window -> doc_id
        self.owner: dict[int, int] = {}
        for doc, each in states:  # only now do all states exist
            for state in each[window - 1 :]:
                self.owner[self.auto.holder(state, window)] = doc

    def starts(self, said: bytes, doc: int) -> list[int]:
        """First words of the windows that stand in a passage of a document with a smaller doc_id."""
        symbols, out = self.symbols, []
        for i, (state, length) in enumerate(self.auto.stream([symbols.get(w, -1) for w in said.split(b" ")])):
            if length >= self.window and self.owner.get(self.auto.holder(state, self.window), doc) < doc:
                out.append(i + 1 - self.window)
        return out


def _decided(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of one shard and salt after another, passages first: one automaton at a time."""
    key, passages, reference = None, [], None
    for batch in batches:
        docs, rows, ats = [], [], []
        for shard, salt, own, doc, row, at, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (shard, salt) != key:
                key, passages, reference = (shard, salt), [], None
            if own:
                passages.append((doc, said))
                continue
            if reference is None:
                reference = Reference(passages, window)
            found = reference.starts(said, doc)
            docs += [doc] * len(found)
            rows += [row] * len(found)
            ats += [at + k for k in found]
        yield pa.record_batch([pa.array(x, pa.int64()) for x in (docs, rows, ats)], names=["doc_id", "row", "at"])
    give_back()


def removed_words(texts: pa.Array, gone: pa.ListArray, window: int = WINDOW):
    """Mask over the words of all texts, and the words' places; gone has the first words of the windows that go."""
    data, offs = X.buffers(texts)
    starts, ends, word_offs = X.words(data, offs, X.NONSPACE)
    at = [word_offs[k] + gone[k].values.to_numpy() for k in range(len(gone)) if gone[k].is_valid]
    change = np.zeros(len(starts) + window + 1, np.int64)
    if at:
        np.add.at(change, np.concatenate(at), 1)
        np.add.at(change, np.concatenate(at) + window, -1)
    return np.cumsum(change)[: len(starts)] > 0, (data, starts, ends, word_offs)


def kept_texts(mask: np.ndarray, places) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    data, starts, ends, word_offs = places
    space = data.copy()
    space[~X.NONSPACE[data]] = 32
    for a, b in zip(starts[mask], ends[mask], strict=True):
        space[a:b] = 32
    begin = np.concatenate([starts, [len(data)]])
    raw = space.tobytes()
    return [b" ".join(raw[begin[a] : ends[b - 1]].split()) if b > a else b"" for a, b in zip(word_offs[:-1], word_offs[1:], strict=True)]


def _with_gone(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """``docs`` with a column of each one's windows that go, and its name; only rows that may have one are shuffled."""
    name, row = unused(docs, "gone"), unused(docs, "row")
    gone = repeated(docs, window).select("doc_id", F.col("row").alias(row), F.col("gone").alias(name))
    some, rest = screened(docs, gone, gone.count())
    joined = some.withColumn(row, F.xxhash64("text")).join(gone, ["doc_id", row], "left").select(*docs.columns, name)
    return joined.union(rest.withColumn(name, F.lit(None).cast("array<bigint>"))), name


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, removed words, and the SHA-256 of what stays."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask, places = removed_words(batch.column("text"), batch.column(name), window)
        word_offs = places[3]
        total = np.concatenate([[0], np.cumsum(mask)])
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(np.diff(word_offs)), pa.array(total[word_offs[1:]] - total[word_offs[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in kept_texts(mask, places)])],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    marked, name = _with_gone(docs.select("doc_id", "text"), window)
    return map_rows(marked, "text", run, REPORT)


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the kept words of each text, joined by one space."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        mask, places = removed_words(batch.column("text"), batch.column(name), window)
        texts = pa.array([x.decode() for x in kept_texts(mask, places)], batch.schema.field("text").type)
        return batch.set_column(batch.schema.get_field_index("text"), "text", texts).drop_columns([name])

    marked, name = _with_gone(docs, window)
    return map_rows(marked, "text", run, docs.schema)


def against_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, start, end): maximal spans of at least ``window`` words that occur in ``reference`` (column text).

    The reference is read in shards of SHARD_BYTES, one automaton each, broadcast one after the other; one
    of more than ``most_bytes`` raises ValueError: use ``repeated`` for a corpus.
    """
    size = reference.select(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"a reference of {size} bytes exceeds {most_bytes}")
    shards: list[tuple[SuffixAutomaton, dict[int, int]]] = []
    room = 0
    for row in reference.select("text").where("text is not null").toLocalIterator():
        raw = row.text.encode()
        if not shards or len(raw) > room:
            shards.append((SuffixAutomaton(), {}))
            room = SHARD_BYTES
        room -= len(raw)
        auto, symbols = shards[-1]
        auto.add([symbols.setdefault(w, len(symbols)) for w in raw.split()])
    held = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, begins, ends = [], [], []
        for k, text in enumerate(batch.column("text").to_pylist()):
            said = (text or "").encode().split()
            mask = np.zeros(len(said) + 2, np.int8)
            for auto, symbols in held.value:
                for i, (_, length) in enumerate(auto.stream(symbols.get(w, -1) for w in said)):
                    if length >= window:
                        mask[i + 2 - length : i + 2] = 1
            for a, b in np.flatnonzero(np.diff(mask)).reshape(-1, 2):
                ids.append(k), begins.append(a), ends.append(b)
        return pa.record_batch([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "start", "end"])

    return map_rows(docs.select("doc_id", "text"), "text", run, "doc_id bigint, start bigint, end bigint")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM g JOIN f USING (h) WHERE low < doc_id),
k AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM r GROUP BY doc_id),
t AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM k)),
l AS (SELECT t.doc_id, string_agg(t.w[t.p], ' ' ORDER BY t.p) AS s FROM t ANTI JOIN r ON r.doc_id = t.doc_id AND r.p = t.p GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(s, '') END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)
"""
