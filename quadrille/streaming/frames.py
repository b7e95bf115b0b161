"""The frame loop as Structured Streaming: a stream of camera frames, state between them in tables.

Each micro-batch holds frames; they are taken in order, since one frame's history decides the next.
History and slots are tables in the shared folder, written anew after each frame, and a frame that is
replayed after a failure starts from the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrille.operators.select import Selection, depth_of, history, select


class Frames:
    """nodes: tile trees; emit is called with each frame's number and selection."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, folder: str, emit: Callable[[int, Selection], None]) -> None:
        self.spark, self.nodes, self.folder, self.emit = spark, nodes, folder, emit
        self.levels = depth_of(nodes)

    def _history(self, frame: int) -> DataFrame | None:
        """What the newest frame before ``frame`` left; frames that haven't finished leave no marker."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path):
            return None
        done = [int(s.getPath().getName().split("=")[1]) for s in store.listStatus(path) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        before = [f for f in done if f < frame]
        return self.spark.read.parquet(f"{self.folder}/frame={max(before)}") if before else None

    def step(self, frame: int, params: DataFrame) -> Selection:
        last = self._history(frame)
        nodes = self.nodes.drop("rendered_last", "refined_last")
        if last is not None:
            nodes = nodes.join(last, ["set_id", "tile"], "left")
        else:
            nodes = nodes.withColumns({"rendered_last": F.lit(False), "refined_last": F.lit(False)})
        nodes = nodes.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("rendered_last", "refined_last")})
        chosen = select(nodes, params, self.levels)
        history(chosen).write.mode("overwrite").parquet(f"{self.folder}/frame={frame}")
        self.emit(frame, chosen)
        return chosen

    def start(self, cameras: DataFrame, checkpoint: str) -> StreamingQuery:
        """cameras: a stream of params rows with their frame number."""

        def batch(rows: DataFrame, _: int) -> None:
            numbers = sorted(r.frame for r in rows.select("frame").distinct().collect())  # a micro-batch's frames
            for frame in numbers:
                self.step(frame, rows.where(F.col("frame") == frame).drop("frame"))

        return cameras.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
