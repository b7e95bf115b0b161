"""View-dependent level-of-detail selection over tile trees.

One camera per set decides from the root down which tiles to refine, and from the leaves up what covers
them: a refined tile whose children don't all cover keeps what was on screen, else shows itself, else asks
to be loaded urgently.  Both passes run by depth, all sets at once, so a step costs one join on the parent
and no set is ever in one task.  Each level is written to the shared folder: plans stay short however deep
the trees are, and a lost executor costs one level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import detail as D
from quadrille.functions import volumes as V
from quadrille.operators.tree import above
from quadrille.tables import ranked, written

URGENT, DESCEND, NORMAL, PRELOAD = range(4)
#: Places in the order of emission: what a tile asks for before and after its children, and after all tiles.
_PROTECT, _BEFORE, _AFTER, _END = -2, -1, (1 << 62) - 1, 1 << 62


@dataclass
class Selection:
    #: nodes with touched, refined, render, covered, any_last
    nodes: DataFrame
    #: set_id, tile, priority, key, seq (the place in the set's order)
    loads: DataFrame


def metrics(nodes: DataFrame, params: DataFrame) -> DataFrame:
    """Distance, screen-space error and threshold of every tile, and whether it wants refining.

    nodes: set_id, tile, parent, path, depth, geometric_error, refine, content_uri, volume, state (none, pending,
    ready, failed), rendered_last, refined_last, culled.  params, one row a set: cam_pos, cam_forward, k_px,
    sse_threshold_px, detail_falloff_m, cam_height_m.
    """
    parents = nodes.where("parent is not null").select("set_id", F.col("parent").alias("tile")).distinct().withColumn("inner", F.lit(True))
    v, cam = "volume", "cam_pos"
    return (
        nodes.join(params, "set_id").join(parents, ["set_id", "tile"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
        .withColumn("near", F.expr(V.distance(v, cam))).withColumn("dist", F.greatest("near", "cam_height_m"))
        .withColumn("sse", F.expr(D.screen_space_error("geometric_error", "dist", "k_px")))
        .withColumn("threshold", F.expr(D.threshold("sse_threshold_px", "dist", "cam_height_m", "detail_falloff_m")))
        .withColumn("key", F.expr(D.load_key(v, "dist", cam, "cam_forward")))
        .withColumn("near_key", F.expr(D.load_key(v, "near", cam, "cam_forward")))
        .withColumn("settled", F.expr("state <> 'pending'")).withColumn("wants", F.expr("inner AND (sse > threshold OR content_uri is null)"))
        .withColumn("protects", F.expr("inner AND NOT wants AND refined_last AND NOT settled"))
        .withColumn("refined", F.expr("wants OR protects"))
        .drop(*(c for c in params.columns if c != "set_id"))
    )


def visited(measured: DataFrame, levels: int) -> list[DataFrame]:
    """By depth: the tiles reached from the roots through refined tiles; culled tiles but not roots are passed by."""
    out = [measured.where("depth = 0")]
    for depth in range(1, levels):
        open_ = out[-1].where("refined").select("set_id", F.col("tile").alias("parent"))
        out.append(written(measured.where(f"depth = {depth} AND NOT culled").join(open_, ["set_id", "parent"], "left_semi")))
    return out


_ALL, _ANY = "coalesce(children_covered, true)", "coalesce(children_last, false)"
_REPLACES = "refined AND refine <> 'ADD'"
#: What becomes of a tile: stop, add, covered, keep, swap or drop.
_CASE = f"CASE WHEN NOT refined THEN 'stop' WHEN refine = 'ADD' THEN 'add' WHEN {_ALL} THEN 'covered' WHEN {_ANY} THEN 'keep' WHEN state = 'ready' THEN 'swap' ELSE 'drop' END"


def resolved(levels: list[DataFrame]) -> list[DataFrame]:
    """By depth: each visited tile's case, whether it covers, and whether anything below was on screen last."""
    out: list[DataFrame] = [None] * len(levels)  # type: ignore[list-item]
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        if depth + 1 < len(levels):
            below = out[depth + 1].groupBy("set_id", F.col("parent").alias("tile")).agg(F.bool_and("covered").alias("children_covered"), F.bool_or("any_last").alias("children_last"))
            here = here.join(below, ["set_id", "tile"], "left")
        else:
            here = here.withColumns({"children_covered": F.lit(None).cast("boolean"), "children_last": F.lit(None).cast("boolean")})
        here = here.withColumn("case", F.expr(_CASE))
        here = here.withColumn("covered", F.expr("CASE WHEN case IN ('stop', 'add') THEN settled ELSE case <> 'drop' END"))
        here = here.withColumn("any_last", F.expr(f"CASE case WHEN 'stop' THEN rendered_last WHEN 'add' THEN rendered_last OR {_ANY} WHEN 'covered' THEN {_ANY} WHEN 'keep' THEN true WHEN 'swap' THEN rendered_last ELSE false END"))
        out[depth] = written(here.drop("children_covered", "children_last"))
    return out


def shown(levels: list[DataFrame]) -> DataFrame:
    """All visited tiles with render: what shows itself and has no strict ancestor that replaced or dropped its subtree."""
    hidden = F.lit(False)
    rows, out = levels[0].withColumn("hidden", hidden), []
    for depth in range(len(levels)):
        if depth:
            over = rows.select("set_id", F.col("tile").alias("parent"), F.expr("hidden OR case IN ('swap', 'drop')").alias("hidden"))
            rows = levels[depth].join(over, ["set_id", "parent"], "left").withColumn("hidden", F.coalesce("hidden", hidden))
        rows = written(rows)
        out.append(rows.withColumn("render", F.expr("NOT hidden AND state = 'ready' AND case IN ('stop', 'add', 'swap')")).drop("hidden"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def loads(seen: DataFrame) -> DataFrame:
    """What visited tiles ask for, and unloaded ancestors of what is shown, in order; a tile may ask twice."""
    pending = seen.where("state = 'pending'")
    ask = F.expr(f"if(dist <= {D.INSIDE}, {URGENT}, {NORMAL})")
    stop = F.expr(f"CASE WHEN dist <= {D.INSIDE} THEN {URGENT} WHEN case = 'stop' AND NOT inner AND sse > threshold THEN {DESCEND} ELSE {NORMAL} END")
    place = lambda k: F.expr(f"array_append(cast(path AS array<bigint>), {k})")
    asked = (
        pending.where("protects").select("set_id", "tile", ask.alias("priority"), "key", place(f"{_PROTECT}L").alias("emitted"))
        .unionByName(pending.where("case IN ('stop', 'add')").select("set_id", "tile", stop.alias("priority"), "key", place(f"{_BEFORE}L").alias("emitted")))
        .unionByName(pending.where("case = 'keep'").select("set_id", "tile", ask.alias("priority"), "key", place(f"{_AFTER}L").alias("emitted")))
        .unionByName(pending.where("case = 'drop'").select("set_id", "tile", F.lit(URGENT).alias("priority"), "key", place(f"{_AFTER}L").alias("emitted")))
    )
    ups = above(seen.where("render")).groupBy("set_id", F.col("up").alias("path")).agg(F.min("path").alias("first"))
    early = seen.where("state = 'pending'").join(ups, ["set_id", "path"]).join(asked.select("set_id", "tile").distinct(), ["set_id", "tile"], "left_anti")
    first = F.expr(f"concat(array({_END}L), cast(first AS array<bigint>), array(cast(-depth AS bigint)))")
    every = asked.unionByName(early.select("set_id", "tile", F.lit(PRELOAD).alias("priority"), F.col("near_key").alias("key"), first.alias("emitted")))
    return ranked(every, ["set_id"], ["priority", "key", "emitted"], "seq").drop("emitted")


def select(nodes: DataFrame, params: DataFrame, levels: int) -> Selection:
    """The selection of every set; ``levels`` is one more than the largest depth.

    Strict ancestors of visited tiles are visited themselves, so preloads need no other rows.
    """
    measured = written(metrics(nodes, params), "depth")
    whole = shown(resolved(visited(measured, levels)))
    flags = whole.select("set_id", "tile", F.lit(True).alias("touched"), "refined", "render", "covered", "any_last", "case")
    asked = loads(whole)
    out = nodes.join(flags, ["set_id", "tile"], "left")
    for name in ("touched", "refined", "render"):
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
    return Selection(out, asked)


def depth_of(nodes: DataFrame) -> int:
    """Levels of the deepest tree; one number comes to the driver."""
    return (nodes.agg(F.max("depth")).first()[0] or 0) + 1


def history(selection: Selection) -> DataFrame:
    """(set_id, tile, rendered_last, refined_last) for the next frame."""
    return selection.nodes.select("set_id", "tile", F.col("render").alias("rendered_last"), F.col("refined").alias("refined_last"))


def content_state(content_uri: str, slot: str) -> str:
    """none, ready, failed or pending from a tile's URI and slot, in SQL text."""
    return f"CASE WHEN {content_uri} is null THEN 'none' WHEN {slot} = 'Ready' THEN 'ready' WHEN {slot} = 'Failed' THEN 'failed' ELSE 'pending' END"
