"""Operator 7: language identification by compression.

Each language has a zstandard raw-content dictionary of sample texts; a text belongs to the language
whose dictionary compresses it smallest, and is rejected where the margin to the next one is narrow.
A text is compressed in pieces, each from the dictionary alone, and the sizes of all its pieces count: a
dictionary is out of the window's reach behind the first of them.

The sample: of each language at most SLOTS documents outside the held-out fold, spread by hash, of each
at most SAMPLE_BYTES from places all over its text, together at most DICTIONARY_BYTES.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; null
languages teach nothing; with no language to learn every text is ``und``; ties go to the language of most
documents outside the held-out fold, then to the first in alphabetical order; of rows that repeat a doc_id
and a language, the first text in order teaches; repeated rows repeat; very long texts are compressed whole;
an empty table gives no rows; other columns are ignored or, in ``keep``, kept.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import fold, local_rows, map_rows, slot_sample, table

SLOTS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1024, 64 << 10
#: Places of a text that a sample is taken from.
PLACES = 8
#: Short matches, since words of a language share endings more than whole words.
PARAMETERS = {"window_log": 17, "chain_log": 15, "hash_log": 15, "search_log": 3, "min_match": 3, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY}
#: Bytes of a piece; with a dictionary it fits the window of PARAMETERS.
PIECE = 64 << 10
#: Bytes of margin at which the score is 0.73.
SCALE = 4.0
#: Texts of at least this many bytes are rejected below this relative margin; shorter ones tell too little to.
NARROW, ENOUGH_BYTES = 0.004, 256
UNKNOWN = "und"
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

REPORT = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"


def letters(text: str) -> bytes:
    """Lower-case letters in UTF-8; what else is ASCII becomes one space."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def learn(docs: DataFrame) -> dict[str, bytes]:
    """language -> dictionary, from documents outside the held-out fold; the most frequent language first."""
    taught = docs.where(fold(F.col("doc_id")) != 0).where("lang is not null and text is not null").select("doc_id", "lang")
    sampled = slot_sample(taught, "lang", "doc_id", SLOTS)
    pairs = local_rows(docs.sparkSession, sampled.collect(), sampled.schema)  # SLOTS rows for each language at most
    share = SAMPLE_BYTES // PLACES
    spread = F.concat_ws(" ", *(F.expr(f"substring(text, cast(length(text) * {k}L div {PLACES} as int) + 1, {share})") for k in range(PLACES)))
    sample = F.when(F.length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(spread)
    taken = docs.where("text is not null").select("lang", "doc_id", sample.alias("text")).join(F.broadcast(pairs), ["lang", "doc_id"])
    rows = taken.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", F.xxhash64("doc_id", F.lit(5)).alias("h"), "doc_id", "text").collect()
    out: dict[str, bytes] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.h, r.doc_id, r.text)):
        if len(have := out.get(row.lang, b"")) < DICTIONARY_BYTES:
            out[row.lang] = (have + letters(row.text)[:SAMPLE_BYTES] + b" ")[:DICTIONARY_BYTES]
    often = {r.lang: r["count"] for r in taught.groupBy("lang").count().collect()}  # a row for each language
    return dict(sorted(out.items(), key=lambda x: (-often[x[0]], x[0])))


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in dictionaries:
        held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
        held.precompute_compress(compression_params=how)
        out.append((lang, zstandard.ZstdCompressor(dict_data=held, compression_params=how)))
    return out


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(text: str | None, dictionaries: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text."""
    if not text or not dictionaries or not _has_letter(text):
        return UNKNOWN, 0.0, True
    raw = letters(text)
    sizes = sorted((sum(len(c.compress(raw[a : a + PIECE])) for a in range(0, len(raw), PIECE)), k, lang) for k, (lang, c) in enumerate(_compressors(dictionaries)))
    best = sizes[0]
    margin = sizes[1][0] - best[0] if len(sizes) > 1 else len(raw)
    return best[2], 1 / (1 + math.exp(-min(margin / SCALE, 40.0))), len(raw) >= ENOUGH_BYTES and margin < NARROW * best[0]


def report(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [predict(t, held.value) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return map_rows(docs.select("doc_id", "text", (fold(F.col("doc_id")) == 0).alias("held_out")), "text", run, REPORT)


def keep(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The documents that aren't rejected, as they are."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries.items()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not predict(t, held.value)[2] for t in batch.column("text").to_pylist()], pa.bool_()))

    return map_rows(docs, "text", run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return report(docs, learn(docs))
