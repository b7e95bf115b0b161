"""Residency: bytes held and pressure, eviction, and what stays visible while finer tiles come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import detail as D
from quadrille.operators.tree import marked_above, marked_below


def load_state(slots: DataFrame, budget: int, external: float = 1.0, most_loads: int = 16, brake: bool = False) -> DataFrame:
    """One row: resident bytes, loads in flight, pressure, free load slots, and whether loads are halted."""
    return (
        slots.agg(F.coalesce(F.sum(F.when(F.col("state") == "Ready", F.col("bytes"))), F.lit(0)).alias("resident"), F.count_if(F.col("state") == "InFlight").alias("in_flight"))
        .withColumn("pressure", F.expr(D.pressure("resident", str(budget), f"{external}D"))).withColumn("free", F.greatest(F.lit(most_loads) - F.col("in_flight"), F.lit(0)))
        .withColumn("halted", F.expr(D.halted("resident", str(budget), str(brake).lower())))
    )


def _spare(slots: DataFrame) -> DataFrame:
    return slots.where("state = 'Ready' AND NOT wanted AND NOT held")


def stale(slots: DataFrame, frame: int, grace: int) -> DataFrame:
    """Ready tiles, neither wanted nor held, that nothing touched for over ``grace`` frames."""
    return _spare(slots).where(F.greatest(F.lit(frame) - F.col("last_touched"), F.lit(0)) > grace)


def overflow(slots: DataFrame, frame: int, grace: int, most: int) -> DataFrame:
    """Beyond the stale ones, each set's longest untouched spare tiles over ``most`` resident; ties go by tile.

    Frames are counted before tiles are ranked, so of a set only the tiles of the one frame in which the
    surplus ends are sorted together.
    """
    gone = stale(slots, frame, grace).select("set_id", "tile")
    left = slots.where("state = 'Ready'").join(gone, ["set_id", "tile"], "left_anti")
    over = left.groupBy("set_id").agg((F.count("*") - most).alias("over")).where("over > 0")
    spare = _spare(left)
    frames = spare.groupBy("set_id", "last_touched").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("set_id").orderBy("last_touched").rowsBetween(Window.unboundedPreceding, -1))
    taken = frames.withColumn("before", F.coalesce(before, F.lit(0))).join(over, "set_id").where("before < over").select("set_id", "last_touched", F.expr("least(n, over - before)").alias("take"), F.expr("n <= over - before").alias("whole"))
    rows = spare.join(taken, ["set_id", "last_touched"])
    rank = F.row_number().over(Window.partitionBy("set_id", "last_touched").orderBy("tile"))
    return rows.where("whole").select(*slots.columns).unionByName(rows.where("NOT whole").withColumn("_rank", rank).where("_rank <= take").select(*slots.columns))


def evicted(slots: DataFrame, frame: int, grace: int, most: int) -> DataFrame:
    """slots: set_id, tile, state, bytes, last_touched, wanted, held."""
    return stale(slots, frame, grace).withColumn("why", F.lit("grace")).unionByName(overflow(slots, frame, grace, most).withColumn("why", F.lit("overflow")))


def hold(nodes: DataFrame, slots: DataFrame) -> DataFrame:
    """Tiles that stay while a wanted Ready tile isn't spawned yet: its strict ancestors and descendants.

    slots: set_id, tile, state, spawned, wanted.
    """
    starved = nodes.join(slots.where("wanted AND state = 'Ready' AND NOT spawned").select("set_id", "tile"), ["set_id", "tile"], "left_semi").select("set_id", "path", "tile")
    return marked_above(nodes, starved).union(marked_below(nodes, starved)).distinct()


def covered_by_coarser(nodes: DataFrame, slots: DataFrame, held: DataFrame) -> DataFrame:
    """Wanted tiles below a held, unwanted, spawned one that is still visible: they wait, so detail swaps one rung at a time."""
    painting = slots.where("state = 'Ready' AND spawned AND visible AND NOT wanted").join(held, ["set_id", "tile"], "left_semi").select("set_id", "tile")
    marks = nodes.join(painting, ["set_id", "tile"], "left_semi").select("set_id", "path")
    return marked_below(nodes, marks).join(slots.where("wanted").select("set_id", "tile"), ["set_id", "tile"], "left_semi")


def respawned(slots: DataFrame, most: int) -> DataFrame:
    """Wanted Ready tiles that come back from the cache this frame: the first ``most`` by set and tile."""
    return slots.where("state = 'Ready' AND wanted AND NOT spawned").orderBy("set_id", "tile").limit(most)


def cut_shape(selected: DataFrame) -> DataFrame:
    """Per set: tiles shown and their smallest and largest depth."""
    return selected.where("render").groupBy("set_id").agg(F.count("*").alias("tiles"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def touched(selected: DataFrame, slots: DataFrame, frame: int) -> DataFrame:
    """Slots with last_touched set to ``frame`` where the selection touched them."""
    marks = selected.where("touched").select("set_id", "tile", F.lit(True).alias("_now"))
    return slots.join(marks, ["set_id", "tile"], "left").withColumn("last_touched", F.when(F.col("_now"), F.lit(frame)).otherwise(F.col("last_touched"))).drop("_now")


