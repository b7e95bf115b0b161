"""Operator 2: benchmark decontamination with a generalised suffix automaton.

The items' normalised words make one automaton.  Training words are streamed through it and
their longest matching lengths tracked; an item window occurs where the length reaches the
window's.  Stretches of a document in which no short run of item words occurs can't reach any
window's length, so whole batches are first screened by run hashes; the automaton decides, on the
words' bytes.

An automaton is broadcast and holds items of SHARD_BYTES at most (or one item).  Items beyond that make
further shards: one is read, broadcast, passed over all documents and dropped before the next.

Defined results: a null or wordless text has no words and no hits; very long texts are read whole; null,
empty and repeated items are allowed; items with a null item_id count as one item, whose id is left out
of the digest; an empty benchmark leaves every document clean; no documents give no rows; ties and
repeated rows have the same result each; other columns are ignored by ``report`` and kept by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import textops as X
from quadrille.llm.automaton import SuffixAutomaton
from quadrille.llm.common import cut, map_rows, table, unused

#: Words of a window.
WINDOW = 10
#: Item bytes that one broadcast automaton holds (some 60 MB of Python objects); further items make further passes.
SHARD_BYTES = 1 << 20
_SCREEN = 4

REPORT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


@dataclass
class Index:
    """An automaton of some items, and what decides from a match which items' windows end there."""

    window: int
    automaton: SuffixAutomaton = field(default_factory=SuffixAutomaton)
    #: word -> symbol
    symbols: dict[bytes, int] = field(default_factory=dict)
    #: state of a full-length window -> item numbers
    full: dict[int, set[int]] = field(default_factory=dict)
    #: state of a short item -> {length: item numbers}
    short: dict[int, dict[int, set[int]]] = field(default_factory=dict)
    ids: list[str | None] = field(default_factory=list)
    least: int = 0
    screen: int = 0
    runs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))


def build(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Index:
    index = Index(window)
    texts = pa.array([t or "" for _, t in items], pa.large_string())
    data, offs = X.buffers(texts)
    data = X.LOWER[data]
    starts, ends, word_offs = X.words(data, offs, X.ALNUM)
    hashes = X.word_hashes(data, starts, ends)
    sizes = np.diff(word_offs)
    if not sizes.any():
        return index
    index.least = int(min(window, sizes[sizes > 0].min()))
    index.screen = min(_SCREEN, index.least)
    first, _ = X.starts_of_runs(word_offs, index.screen)
    index.runs = np.unique(X.run_hashes(hashes, index.screen)[first])
    index.seen[(index.runs & X.U64(0xFFFF)).astype(np.int64)] = True
    prefixes, said = [], X.spelled(data, starts, ends)
    for k, (item, _) in enumerate(items):
        symbols = [index.symbols.setdefault(w, len(index.symbols)) for w in said[word_offs[k] : word_offs[k + 1]]]
        index.ids.append(item)
        prefixes.append(index.automaton.add(symbols))
    for k, states in enumerate(prefixes):  # only now do all states exist
        if len(states) >= window:
            for state in states[window - 1 :]:
                index.full.setdefault(index.automaton.holder(state, window), set()).add(k)
        elif states:
            size = len(states)
            index.short.setdefault(index.automaton.holder(states[-1], size), {}).setdefault(size, set()).add(k)
    return index


@dataclass
class Words:
    """The words of a batch's texts: their bytes in lower case, places, hashes, and each text's first."""

    data: np.ndarray
    low: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_offs: np.ndarray

    @classmethod
    def read(cls, texts: pa.Array) -> Words:
        data, offs = X.buffers(texts)
        low = X.LOWER[data]
        return cls(data, low, offs, *X.words(low, offs, X.ALNUM))


#: document number -> (mask of its words, ids of the items met)
Hits = dict[int, tuple[np.ndarray, set[str | None]]]


def scan(words: Words, index: Index, out: Hits) -> None:
    """Adds the hits of an index to those of others."""
    starts, ends, word_offs = words.starts, words.ends, words.word_offs
    if not len(index.runs) or not len(starts):
        return
    k, auto = index.screen, index.automaton
    first, run_offs = X.starts_of_runs(word_offs, k)
    runs = X.run_hashes(X.word_hashes(words.low, starts, ends), k)[first]
    maybe = np.flatnonzero(index.seen[(runs & X.U64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.runs, runs[maybe]), len(index.runs) - 1)
    maybe = maybe[index.runs[at] == runs[maybe]]
    if not len(maybe):
        return
    docs = np.searchsorted(run_offs, maybe, side="right") - 1
    breaks = np.flatnonzero((np.diff(maybe) != 1) | (np.diff(docs) != 0)) + 1
    for group in np.split(np.arange(len(maybe)), breaks):
        doc, begin = int(docs[group[0]]), int(first[maybe[group[0]]])
        size = len(group) + k - 1
        if size < index.least:
            continue
        said = X.spelled(words.low, starts[begin : begin + size], ends[begin : begin + size])
        for i, (state, length) in enumerate(auto.stream(index.symbols.get(w, -1) for w in said)):
            best, met = 0, None
            if length >= index.window:
                best, met = index.window, set(index.full.get(auto.holder(state, index.window), ()))
            if index.short:
                up = state
                while up > 0:
                    for n, items in index.short.get(up, {}).items():
                        if n <= length:
                            best, met = max(best, n), (met or set()) | items
                    up = auto.link[up]
            if met:
                mask, items = out.setdefault(doc, (np.zeros(int(word_offs[doc + 1] - word_offs[doc]), bool), set()))
                to = begin + i + 1 - int(word_offs[doc])
                mask[to - best : to] = True
                items |= {index.ids[k] for k in met}


def shards(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[DataFrame]:
    """The items in parts of about ``shard_bytes`` at most, by a hash of their contents."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    count = 1 if size <= shard_bytes else -(-2 * size // shard_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items for k in range(count)]


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, finish: Callable[[pa.RecordBatch, Words, Hits], pa.RecordBatch], schema: str) -> DataFrame:
    """``finish`` over batches of ``docs`` with the hits of all items; between shards the hits are columns of a written table."""
    spans, met = unused(docs, "spans"), unused(docs, "met")
    parts = shards(benchmark, shard_bytes)

    def one(docs: DataFrame, index: Index, carried: bool, last: bool) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, hits = Words.read(batch.column("text")), {}
            if carried:
                sizes = np.diff(words.word_offs)
                for k, (at, items) in enumerate(zip(batch.column(spans).to_pylist(), batch.column(met).to_pylist(), strict=True)):
                    if at:
                        mask = np.zeros(int(sizes[k]), bool)
                        for a, b in zip(at[::2], at[1::2], strict=True):
                            mask[a:b] = True
                        hits[k] = (mask, set(items))
                batch = batch.drop_columns([spans, met])
            scan(words, held.value, hits)
            if last:
                return finish(batch, words, hits)
            at = [edges(hits[k][0]).reshape(-1).tolist() if k in hits else None for k in range(batch.num_rows)]
            items = [list(hits[k][1]) if k in hits else None for k in range(batch.num_rows)]
            return batch.append_column(spans, pa.array(at, pa.list_(pa.int32()))).append_column(met, pa.array(items, pa.list_(pa.string())))

        if last:
            return map_rows(docs, "text", run, schema)
        inner = docs.drop(spans, met) if carried else docs
        fields = inner.withColumn(spans, F.lit(None).cast("array<int>")).withColumn(met, F.lit(None).cast("array<string>")).schema
        out = cut(map_rows(docs, "text", run, fields))
        held.destroy()
        return out

    for k, part in enumerate(parts):
        index = build([(r.item_id, r.text) for r in part.orderBy("item_id", "text").toLocalIterator()], window)
        docs = one(docs, index, k > 0, k + 1 == len(parts))
    return docs


def edges(mask: np.ndarray) -> np.ndarray:
    """Rows (first, end) of the runs of a mask."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: words, words inside benchmark windows, and the items they come from."""

    def finish(batch: pa.RecordBatch, words: Words, hits: Hits) -> pa.RecordBatch:
        n_hit = np.zeros(batch.num_rows, np.int64)
        n_items, digests = n_hit.copy(), [hashlib.sha256(b"").hexdigest()] * batch.num_rows
        for k, (mask, items) in hits.items():
            n_hit[k], n_items[k] = mask.sum(), len(items)
            digests[k] = hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()
        return pa.record_batch(
            [batch.column("doc_id"), pa.array(np.diff(words.word_offs).astype(np.int64)), pa.array(n_hit), pa.array(n_items), pa.array(digests, pa.string()), pa.array(n_hit > 0)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    return _scanned(docs.select("doc_id", "text"), benchmark, window, shard_bytes, finish, REPORT)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents without the passages that benchmark windows cover; those covered beyond ``most_coverage`` go whole.

    A passage goes from its first word to its last with what stands between; other characters stay.
    """

    def finish(batch: pa.RecordBatch, words: Words, hits: Hits) -> pa.RecordBatch:
        if not hits:
            return batch
        texts, keep = batch.column("text").to_pylist(), np.ones(batch.num_rows, bool)
        for k, (mask, _) in hits.items():
            if mask.sum() > most_coverage * len(mask):
                keep[k] = False
                continue
            base, begin = int(words.word_offs[k]), int(words.offs[k])
            raw, left, parts = words.data[begin : words.offs[k + 1]].tobytes(), 0, []
            for a, b in edges(mask):
                parts.append(raw[left : words.starts[base + a] - begin])
                left = int(words.ends[base + b - 1] - begin)
            texts[k] = b"".join([*parts, raw[left:]]).decode()
        out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))
        return out.filter(pa.array(keep))

    return _scanned(docs, benchmark, window, shard_bytes, finish, docs.schema)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win USING (n, g)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""
