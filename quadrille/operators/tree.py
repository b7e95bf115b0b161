"""Tile trees: flattening tileset documents, grafting external ones, closures and pruning.

A tree is rows of (set_id, tile, parent, depth, path, geometric_error, refine, content_uri, volume,
world_from_tile, world_from_content).  ``path`` orders tiles depth first, and ancestors' paths are its prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geodesy as G
from quadrille.functions import linear as L
from quadrille.functions import uris as U
from quadrille.functions import volumes as V
from quadrille.tables import ranked, written

#: Levels below a root that a document may have.
MOST_LEVELS = 256


def _get(node: str, at: str, kind: str) -> str:
    return f"variant_get({node}, '$.{at}', '{kind}')"


def _own_volume(world: str, frame: str) -> str:
    """The volume of a node's box, ball or region, in this order, in world space; null where there is none, or a region in a local tree."""
    return (
        f"CASE WHEN box is not null THEN {V.moved(V.obb('slice(box, 1, 3)', 'slice(box, 4, 9)'), world)} "
        f"WHEN ball is not null THEN {V.moved(V.sphere('ball', 'ball[3]'), world)} "
        f"WHEN region is not null AND {frame} = 'ecef' THEN {G.region_volume('region')} END"
    )


def flatten(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Trees of tileset documents (set_id, frame, doc variant), whose tiles get the ``carried`` columns of their document.

    Optional columns base_path, base_world, base_refine and base_volume place a root below a tile.  Children
    inherit refine and volume, matrices compose downwards; a root without a usable volume is an error.
    """
    for name, value in (("base_path", "cast(array() AS array<int>)"), ("base_world", L.IDENTITY), ("base_refine", "'REPLACE'"), ("base_volume", f"cast(null AS {V.TYPE})")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.expr(value))
    same, spark = ["set_id", "frame", *carried], docs.sparkSession

    def placed(nodes: DataFrame, otherwise: str) -> DataFrame:
        """Nodes with what their tiles need, each member read once; ``otherwise`` is the volume where there is none to inherit."""
        read = nodes.selectExpr(
            *same, "path", f"coalesce({_get('node', 'refine', 'string')}, above_refine) AS refine", "above_world", "above_volume", f"{_get('node', 'transform', 'array<double>')} AS moves",
            f"{_get('node', 'boundingVolume.box', 'array<double>')} AS box", f"{_get('node', 'boundingVolume.sphere', 'array<double>')} AS ball", f"{_get('node', 'boundingVolume.region', 'array<double>')} AS region",
            f"{_get('node', 'geometricError', 'double')} AS geometric_error", f"coalesce({_get('node', 'content.uri', 'string')}, {_get('node', 'content.url', 'string')}) AS content_uri",
            f"{_get('node', 'children', 'variant')} AS children",
        )
        moved = read.withColumn("world", F.expr(f"if(moves is null, above_world, {L.multiply('above_world', 'moves')})"))
        return moved.selectExpr(*same, "path", "refine", "world", f"coalesce({_own_volume('world', 'frame')}, above_volume{otherwise}) AS volume", "geometric_error", "content_uri", "children")

    roots = docs.selectExpr(
        *same, "if(size(base_path) = 0, array(0), base_path) AS path", "base_refine AS above_refine", "base_world AS above_world", "base_volume AS above_volume",
        "variant_get(doc, '$.root', 'variant') AS node",
    )
    level = written(placed(roots, f", cast(raise_error('a root has no usable bounding volume') AS {V.TYPE})"))
    levels: list[DataFrame] = []
    while not levels or not level.isEmpty():  # a level is a table; sets of any number and size stay spread over all tasks
        if len(levels) > MOST_LEVELS:
            raise ValueError(f"a document has more than {MOST_LEVELS} levels below its root")
        levels.append(level)
        below = spark.sql(
            f"""SELECT {', '.join(f't.`{c}`' for c in same)}, array_append(t.path, c.pos) AS path, t.refine AS above_refine, t.world AS above_world, t.volume AS above_volume, c.value AS node
            FROM {{level}} t, LATERAL variant_explode(t.children) AS c""",
            level=level.where("children is not null"),
        )
        # The children of a node come out of one task, however many they are; they are dealt before anything is computed.
        level = written(placed(below.hint("rebalance", "set_id", "path"), ""))
    return reduce(DataFrame.union, levels).selectExpr(
        "set_id", "path", "size(path) - 1 AS depth", "geometric_error", "upper(refine) AS refine", "content_uri", "volume", "world AS world_from_tile",
        f"{L.multiply('world', L.YUP_TO_ZUP)} AS world_from_content", *carried,
    )


def numbered(nodes: DataFrame, first: Column | None = None) -> DataFrame:
    """``nodes`` with tile, their depth-first number in their set (from ``first``), and parent."""
    rows = ranked(nodes, ["set_id"], ["path"], "tile")
    rows = rows if first is None else rows.withColumn("tile", F.col("tile") + first)
    above = rows.select("set_id", F.col("path").alias("_above"), F.col("tile").alias("parent"))
    return rows.withColumn("_above", F.expr("slice(path, 1, size(path) - 1)")).join(above, ["set_id", "_above"], "left").drop("_above")


def build(docs: DataFrame) -> DataFrame:
    return numbered(flatten(docs))


def graft(nodes: DataFrame, external: DataFrame) -> DataFrame:
    """``nodes`` with external documents (set_id, at, frame, doc) below the tiles ``at``.

    An external root becomes its host's last child and inherits from it; relative URIs are seen from the
    host document's directory; the host's own URI goes, since its content is what was grafted.
    """
    fans = nodes.where("parent is not null").groupBy("set_id", F.col("parent").alias("at")).agg(F.max(F.element_at("path", -1)).alias("last"))
    hosts = external.join(nodes.withColumnRenamed("tile", "at"), ["set_id", "at"]).join(fans, ["set_id", "at"], "left")
    docs = hosts.select("set_id", "frame", "doc", F.expr("array_append(path, coalesce(last, -1) + 1)").alias("base_path"), F.col("world_from_tile").alias("base_world"), F.col("refine").alias("base_refine"), F.col("volume").alias("base_volume"), F.col("content_uri").alias("_host"), F.col("at").alias("_host_tile"))
    found = flatten(docs, ("_host", "_host_tile"))  # tiles bring their host along: to look for it by path is to try all hosts of a set
    new = found.withColumn("content_uri", F.expr(f"if(content_uri is null OR _host is null, content_uri, {U.rebased('content_uri', '_host')})")).drop("_host")
    sizes = nodes.groupBy("set_id").agg((F.max("tile") + 1).alias("_first"))
    new = numbered(new.join(sizes, "set_id"), F.col("_first")).withColumn("parent", F.coalesce("parent", "_host_tile")).drop("_first", "_host_tile")
    cleared = nodes.join(external.select("set_id", F.col("at").alias("tile")).distinct().withColumn("_host", F.lit(True)), ["set_id", "tile"], "left")
    return cleared.withColumn("content_uri", F.expr("if(_host, null, content_uri)")).drop("_host").unionByName(new)


def above(nodes: DataFrame) -> DataFrame:
    """(set_id, path, tile, up): each tile with each of its strict ancestors' paths."""
    return nodes.where("size(path) > 1").select("set_id", "path", "tile", F.explode(F.expr("transform(sequence(1, size(path) - 1), k -> slice(path, 1, k))")).alias("up"))


def marked_below(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct (set_id, tile) of the tiles with a strict ancestor in ``marks`` (set_id, path)."""
    return above(nodes).join(marks.select("set_id", F.col("path").alias("up")), ["set_id", "up"], "left_semi").select("set_id", "tile").distinct()


def marked_above(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Distinct (set_id, tile) of the strict ancestors of ``marks`` (set_id, path, tile)."""
    ups = above(marks).select("set_id", F.col("up").alias("path")).distinct()
    return nodes.join(ups, ["set_id", "path"], "left_semi").select("set_id", "tile")


def retain(nodes: DataFrame, keep: Column) -> DataFrame:
    """The kept tiles, numbered anew in the order of their old numbers; ``was`` is the old number."""
    kept = ranked(nodes.where(keep).withColumnRenamed("tile", "was"), ["set_id"], ["was"], "tile")
    names = kept.select("set_id", F.col("was").alias("parent"), F.col("tile").alias("_parent"))
    return kept.join(names, ["set_id", "parent"], "left").withColumn("parent", F.col("_parent")).drop("_parent")


def compact(nodes: DataFrame, slots: DataFrame, grafts: DataFrame, frame: int, grace: int) -> DataFrame:
    """``nodes`` without grafted subtrees (grafts: set_id, at, child_root, uri) that are stale and hold nothing.

    A subtree goes if its root was last touched over ``grace`` frames ago and no tile in it is Ready or InFlight;
    its host gets its URI back.  slots: set_id, tile, state, last_touched.
    """
    at = nodes.join(slots.select("set_id", "tile", "state", "last_touched"), ["set_id", "tile"], "left")
    roots = grafts.join(at.select("set_id", F.col("tile").alias("child_root"), F.col("path").alias("root"), "last_touched"), ["set_id", "child_root"])
    stale = roots.where(F.greatest(F.lit(frame) - F.coalesce("last_touched", F.lit(0)), F.lit(0)) > grace)
    inner = at.select("set_id", "tile", "state", F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("root")).join(stale.select("set_id", "root").distinct(), ["set_id", "root"])
    gone = inner.groupBy("set_id", "root").agg(F.bool_or(F.coalesce("state", F.lit("NotLoaded")).isin("Ready", "InFlight")).alias("held")).where("not held").select("set_id", "root")
    lost = inner.join(gone, ["set_id", "root"], "left_semi").select("set_id", "tile").distinct()
    back = stale.join(gone, ["set_id", "root"], "left_semi").groupBy("set_id", F.col("at").alias("tile")).agg(F.max("uri").alias("_uri"))
    left = nodes.join(lost, ["set_id", "tile"], "left_anti").join(back, ["set_id", "tile"], "left")
    return retain(left.withColumn("content_uri", F.coalesce("_uri", "content_uri")).drop("_uri"), F.lit(True))
