"""The corpus pipeline: language ID, near-dedup, decontamination, PII and BPE, each over what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, whatever they are, in their order.  Very long texts pass whole; an empty table stays empty; columns
beside doc_id and text pass as they are, whatever their names, but for n_chars, which follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, decontamination, language_id, near_dedup, pii
from quadrille.llm.common import table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null texts and texts without a letter go, and those of at least 256 letter bytes whose two best languages are
    too close; shorter ones stay.  Repeated rows stay or go alike; with no language to learn all go.
    """
    return language_id.keep(docs, language_id.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, similarity 0.8).

    Null and wordless texts stay.  Rows of one doc_id are one document and stay or go together; of different texts
    the one whose set has the smallest digest stands for it.
    """
    return near_dedup.keep(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those of which more than half of the words are benchmark go.

    Null and wordless texts stay as they are, and so does everything with an empty benchmark.
    """
    return _counted(decontamination.remove(docs, table(spark, sf_dir, "benchmark")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null, spans that overlap are replaced together."""
    return _counted(pii.redact(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to; a null text has no ids."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact_personal_data),
    ("bpe", tokenize),
]

#: SQL can express neither compression nor trained models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
