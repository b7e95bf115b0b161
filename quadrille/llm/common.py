"""What the corpus operators share: table access, Arrow mapping, shared-folder tables, held-out folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import Row, StructType

from quadrille.llm.textops import slices
from quadrille.ship import ship
from quadrille.tables import written as cut


_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of an Arrow batch that a Python worker is sent, about, except where a single row is longer.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has Spark send batches of about BATCH_BYTES, where the session allows larger ones (64 MB unless set).

    Every task holds a batch twice, in its executor's JVM and in its worker, and neither gives all of the room back.
    Spark reads the setting when a query runs, which may be after its operator has returned: it stays in the session.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def local_rows(spark: SparkSession, rows: list[Row], schema: StructType) -> DataFrame:
    """A few rows of the driver; through Arrow, since from a list Spark makes an RDD that starts Python workers of its own kind."""
    return spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in rows], to_arrow_schema(schema)), schema)


def give_back() -> None:
    """Returns what a batch has freed to the system: workers live long and are many."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 1 << 18) -> DataFrame:
    """``fn`` over the rows in slices of at most ``most`` bytes of ``column`` (a single longer text is a slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
            give_back()

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out of every training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def slot_sample(df: DataFrame, label: str, key: str, slots: int) -> DataFrame:
    """At most ``slots`` keys of each label, spread evenly: of each hash slot the key with the smallest hash.

    Only counts-sized partial aggregates are shuffled, so a label that holds most rows is no hot group.
    """
    at = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(slots))
    return df.groupBy(F.col(label).alias(label), at.alias("_slot")).agg(F.min_by(key, F.xxhash64(F.col(key), F.lit(29))).alias(key)).drop("_slot")


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, for what an operator carries along."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


#: Keys that are taken out of a shuffle at most, and rows of a key from which it is.
HOT_KEYS, HOT_ROWS = 1 << 14, 1000


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner", ready: bool = False) -> DataFrame:
    """``left`` with the one row of ``right`` for its keys; no key brings more than a small share of the rows into one task.

    ``weight`` of ``right`` (kept) counts the rows of ``left``.  The HOT_KEYS heaviest keys are broadcast, so
    any other key holds less than a HOT_KEYS-th of all rows, or fewer than HOT_ROWS.  ``right`` is written first,
    unless it is ``ready`` to be read twice.
    """
    right = right if ready else cut(right)
    rows = right.where(F.col(weight) > HOT_ROWS).orderBy(F.desc(weight), *keys).limit(HOT_KEYS).collect()
    if not rows:
        return left.join(right, keys, how)
    hot = F.broadcast(local_rows(right.sparkSession, rows, right.schema))
    return left.join(hot, keys).unionByName(left.join(hot.select(*keys), keys, "left_anti").join(right, keys, how))


def offsets_of(lengths) -> pa.Array:
    """List offsets for :class:`pa.ListArray` from list lengths."""
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


#: Bits of the largest bitmap that is broadcast: 64 MB.
MOST_BITS = 1 << 29


def bitmap(values: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the low bits of a bigint column, for screening rows before a join decides.

    It has 16 bits a value and MOST_BITS at most; a fuller one lets more rows pass and loses none.
    """
    bits = min(MOST_BITS, 1 << max(15, (16 * count).bit_length()))
    at = F.pmod(F.col(values.columns[0]), F.lit(bits)) + 1  # Spark's buckets count from 1
    rows = values.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).toLocalIterator()
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[(row.k - 1) * 4096 : row.k * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


def in_bitmap(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def screened(docs: DataFrame, ids: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, text, ...) by a bitmap of ids: those that may be among them, and those that aren't."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select("doc_id"), count))

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield batch.filter(pa.array(in_bitmap(ids, held.value) == wanted))

        return docs.mapInArrow(run, docs.schema)

    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return part(True), part(False)
