"""Operator 10: quality classifier, hashed word n-gram logistic regression trained with FTRL-proximal.

Features of a text are hashed unigrams and bigrams of its words and of the words' shapes (runs of letters,
capitals and digits collapsed, other signs kept, ``=`` for a word that repeats the one before), as shares
of all.  The score is the logistic function of a sparse dot product with the weights.

Training takes at most SLOTS labelled documents of each label outside the held-out fold, spread by hash;
it reads whole texts, as scoring does, on the executors: the driver gets at most 2 ** BITS shares of each.

Defined results: null, empty and wordless texts score by the intercept alone; very long texts are read
whole; documents with several labels teach each; of rows that repeat a labelled doc_id, the one with the
first text in order teaches; with no labels every score is 0.5; a score at the threshold predicts 1;
repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import textops as X
from quadrille.llm.common import fold, map_rows, offsets_of, slot_sample, table

BITS = 18
SLOTS, EPOCHS = 1536, 4
#: A text's shares sum to this.
SCALE = 8.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.02
THRESHOLD = 0.3

REPORT = "doc_id bigint, held_out boolean, score double, predicted int"

_B = np.arange(256)
_SHAPE = np.where((_B >= 97) & (_B <= 122) | (_B >= 128), 97, np.where((_B >= 65) & (_B <= 90), 65, np.where((_B >= 48) & (_B <= 57), 48, _B))).astype(np.uint8)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, and each text's first (one more entry at the end)."""
    data, offs = X.buffers(texts)
    starts, ends, word_offs = X.words(data, offs, X.NONSPACE)
    words = X.word_hashes(data, starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = X.word_hashes(shape[keep], place[starts], place[ends])
    number = np.repeat(np.arange(len(texts)), np.diff(word_offs))
    follows = np.zeros(len(words), bool)
    follows[1:] = number[1:] == number[:-1]
    shapes[1:][(words[1:] == words[:-1]) & follows[1:]] = X.U64(61)
    out = np.empty((len(words), 4), np.uint32)
    top = X.U64(64 - BITS)
    for k, base in enumerate((words, shapes)):
        out[:, 2 * k] = X.mix(base + X.U64(k + 1)) >> top
        before = np.concatenate([base[:1] * X.U64(0), base[:-1]])
        before[~follows] = X.U64(0)
        out[:, 2 * k + 1] = X.mix(base * X.U64(3) ^ X.mix(before + X.U64(k + 11))) >> top
    return out.reshape(-1), 4 * word_offs


def shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's features and their shares of SCALE; the last is the intercept."""
    flat, offs = features(texts)
    out = []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        at, count = np.unique(flat[a:b], return_counts=True)
        out.append((np.append(at.astype(np.int64), 1 << BITS), np.append(count * (SCALE / max(b - a, 1)), 1.0)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights by feature, the last the intercept, from texts' shares and labels."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    weights = np.zeros_like(z)
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = rows[k]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    live = np.abs(z) > L1
    weights[live] = -(z[live] - np.sign(z[live]) * L1) / ((BETA + np.sqrt(n[live])) / ALPHA + L2)
    return weights


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the labelled documents outside the held-out fold."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 0).distinct()
    chosen = slot_sample(known, "label", "doc_id", SLOTS).collect()
    by_id: dict[int, list[int]] = {}
    for row in chosen:
        by_id.setdefault(row.doc_id, []).append(row.label)
    if not by_id:
        return train([], [])
    taken = docs.where(F.col("doc_id").isin(list(by_id))).groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shares(batch.column("text"))
        lists = [pa.ListArray.from_arrays(offsets_of([len(f[k]) for f in found]), pa.array(np.concatenate([f[k] for f in found]))) for k in (0, 1)]
        return pa.record_batch([batch.column("doc_id"), *lists], names=["doc_id", "at", "share"])

    found = sorted(map_rows(taken, "text", run, "doc_id bigint, at array<bigint>, share array<double>").collect(), key=lambda r: r.doc_id)
    pairs = [((np.array(r.at), np.array(r.share)), label) for r in found for label in sorted(by_id[r.doc_id])]
    return train([p[0] for p in pairs], [p[1] for p in pairs])


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    flat, at = features(texts)
    total = np.concatenate([[0.0], np.cumsum(weights[flat])])
    size = np.diff(at)
    dot = (total[at[1:]] - total[at[:-1]]) * SCALE / np.maximum(size, 1) + weights[-1]
    return np.round(1 / (1 + np.exp(-np.clip(dot, -35, 35))), 9)


def report(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).astype(np.float64))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = scores(batch.column("text"), held.value)
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_rows(docs.select("doc_id", "text", (fold(F.col("doc_id")) == 0).alias("held_out")), "text", run, REPORT)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return report(docs, learn(docs, table(spark, sf_dir, "labels")))
