"""Load scheduling: candidates of all sets, fair order, admission, and payloads that come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.tables import ranked


def candidates(loads: DataFrame, slots: DataFrame, classes: DataFrame) -> DataFrame:
    """Loads that can start, with their rank in their set, and whether they are the first of a set with nothing ready.

    loads: set_id, tile, seq, content_uri; slots: set_id, tile, state; classes: set_id, class (absent: 0).
    Ranks count what can start only; a tile that asks twice counts twice.
    """
    ready = slots.groupBy("set_id").agg(F.bool_or(F.col("state") == "Ready").alias("has_ready"))
    open_ = loads.where("content_uri is not null").join(slots.where("state <> 'NotLoaded'").select("set_id", "tile"), ["set_id", "tile"], "left_anti")
    return (
        ranked(open_, ["set_id"], ["seq"], "within").join(ready, "set_id", "left").join(classes, "set_id", "left")
        .select("set_id", "tile", F.coalesce("class", F.lit(0)).alias("class"), F.expr("within = 0 AND NOT coalesce(has_ready, false)").alias("starving_root"), "within")
    )


def fair_order(cands: DataFrame, cursors: DataFrame) -> tuple[DataFrame, list]:
    """``cands`` and the sort keys: starving roots, class, rank, sets after their class's cursor first, set.

    cursors: class, set_id of the last granted set; a class without one starts with the lowest set.
    """
    rows = cands.join(F.broadcast(cursors.select("class", F.col("set_id").alias("cursor"))), "class", "left")
    rows = rows.withColumn("wrapped", F.expr("cursor is null OR set_id <= cursor"))
    return rows, [F.col("starving_root").desc(), F.col("class"), F.col("within"), F.col("wrapped"), F.col("set_id"), F.col("tile")]


def admit(cands: DataFrame, cursors: DataFrame, free: int) -> DataFrame:
    """The first ``free`` candidates over all sets, each tile once, with their grant number."""
    rows, order = fair_order(cands, cursors)
    first = rows.groupBy("set_id", "tile").agg(F.min_by(F.struct(*rows.columns), F.struct((~F.col("starving_root")).alias("s"), "class", "within")).alias("r")).select("r.*")
    top = first.orderBy(*order).limit(max(free, 0))
    return top.withColumn("grant", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint")).select("set_id", "tile", "class", "within", "starving_root", "grant")


def free_slots(most: int, in_flight: int) -> int:
    return max(most - in_flight, 0)


def advanced(cursors: DataFrame, granted: DataFrame) -> DataFrame:
    """Cursors after a frame: the set granted last in each class."""
    new = granted.groupBy("class").agg(F.max_by("set_id", "grant").alias("set_id"))
    return new.unionByName(cursors.join(new, "class", "left_anti").select("class", "set_id"))


def aborted(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """In-flight loads that nothing wants any more."""
    return slots.where("state = 'InFlight'").join(wanted.select("set_id", "tile"), ["set_id", "tile"], "left_anti")


def landed(payloads: DataFrame, slots: DataFrame) -> DataFrame:
    """Payloads (set_id, tile, generation, ...) whose slot still waits for that generation; late ones are dropped."""
    return payloads.join(slots.where("state = 'InFlight'").select("set_id", "tile", "generation"), ["set_id", "tile", "generation"], "left_semi")


def bounded_intake(messages: DataFrame, most: int) -> DataFrame:
    """Messages (seq, lands) up to the ``most``-th that lands content; those that don't land don't count."""
    limit = messages.where("lands").orderBy("seq").limit(most).agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    cut = messages.join(F.broadcast(limit)).where(f"n < {most} OR seq <= last").drop("n", "last")
    # Those that land number themselves; the others stand behind the last of these before them, of which there are at most ``most``.
    landing = cut.where("lands").select("seq").orderBy("seq").limit(most)
    places = landing.agg(F.array_sort(F.collect_list("seq")).alias("places"))
    return cut.join(F.broadcast(places)).withColumn("landed_before", F.expr("cast(size(filter(places, p -> p < seq)) as bigint)")).drop("places")


def decode_stats(decodes: DataFrame, *keys: str) -> DataFrame:
    """Tiles, sums and means of the four stages, and the worst total of decodes (stage_ms array<double>)."""
    stages = [F.sum(F.col("stage_ms")[k]).alias(f"ms_{k}") for k in range(4)]
    total = F.aggregate("stage_ms", F.lit(0.0), lambda s, x: s + x)
    rows = decodes.groupBy(*keys).agg(F.count("*").alias("tiles"), *stages, F.max(total).alias("worst_ms"))
    return rows.withColumns({f"avg_{k}": F.col(f"ms_{k}") / F.greatest("tiles", F.lit(1)) for k in range(4)})


def credits(lines: DataFrame, column: str, *keys: str) -> DataFrame:
    """Distinct credit lines per key: split at semicolons, trimmed, empty ones dropped, sorted."""
    each = lines.select(*keys, F.explode(F.split(column, ";")).alias("line")).select(*keys, F.trim("line").alias("line")).where("line <> ''").distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("line")).alias("credits"))
