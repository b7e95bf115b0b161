"""Tables in the shared folder, with which lineage is cut, and numbering of rows without a window over whole groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and there is no cluster, one beside the warehouse."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no recomputation; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quadrille-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more, instead of when the application ends."""
    for table in tables:
        if files := table.inputFiles():
            spark = table.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{files[0].split('/')[-2]}")
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def bucketed(df: DataFrame, column: str) -> Iterator[DataFrame]:
    """``df`` written to the shared folder in as many buckets by ``column`` as shuffles have partitions; it goes at the end.

    A join on that column deals the other side alone, however often the table is joined.  Only the session's catalogue tells
    Spark of buckets, so the table has a name there, of its own, for as long.
    """
    spark = df.sparkSession
    name = f"quadrille_{uuid.uuid4().hex}"
    path, entry = f"{shared_folder(spark)}/{name}", f"spark_catalog.default.{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    try:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").option("path", path).bucketBy(buckets, column).saveAsTable(entry)
        yield spark.table(entry)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {entry}")
        files.delete(where, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go when it ends, instead of when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in its group's order.

    A window would sort a whole group in one task.  Here ranges of (group, order) are sorted, and a table with a
    row for each part of a group in a range, of which there are no more than groups and ranges together, tells where parts start.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)) - F.col("_first"))
    parts = parts.select(*(F.col(g).alias(f"_{k}") for k, g in enumerate(group)), F.col("_part").alias("_same"), "_before")
    same = [F.col(g).eqNullSafe(F.col(f"_{k}")) for k, g in enumerate(group)] + [F.col("_part") == F.col("_same")]
    return rows.join(parts, same).select(*df.columns, (F.col("_at") + F.col("_before")).cast("bigint").alias(name))
