"""Decoded geometry as tables: features of triangles, submeshes, bounds, resident cost.

vertices: tile, mesh, prim, vertex, ... ; triangles: tile, mesh, prim, triangle, v0, v1, v2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PRIM = ["tile", "mesh", "prim"]


def feature_of_triangles(triangles: DataFrame, ids: DataFrame) -> DataFrame:
    """Each triangle's feature: the rounded id of its first vertex; 0 where the vertex has none.

    ids: tile, mesh, prim, vertex, feature (float); primitives without ids have no features.
    """
    known = ids.select(*_PRIM).distinct()
    rows = triangles.join(known, _PRIM, "left_semi").join(ids.withColumnRenamed("vertex", "v0"), [*_PRIM, "v0"], "left")
    # Half away from zero, and nothing below zero.
    return rows.withColumn("feature", F.greatest(F.coalesce(F.floor(F.col("feature") + F.lit(0.5)), F.lit(0)), F.lit(0)).cast("bigint"))


def owners(features: DataFrame, paths: DataFrame, resolved: DataFrame, anchor: str) -> DataFrame:
    """Features with their node path, and the path's owner; the anchor owns what resolves to nothing.

    paths: tile, feature, node_path; resolved: node_path, owner.
    """
    return features.join(paths, ["tile", "feature"], "left").join(resolved, "node_path", "left").withColumn("owner", F.coalesce(F.expr("nullif(owner, '')"), F.lit(anchor)))


def submesh(triangles: DataFrame, vertices: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen triangles (tile, mesh, prim, triangle, place) as index rows over renumbered vertices.

    Vertices are numbered in the order in which they are first seen; corners whose vertex doesn't exist are left out.
    """
    corners = chosen.join(triangles, [*_PRIM, "triangle"]).select(*_PRIM, "place", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vertex"))
    slots = corners.join(vertices.select(*_PRIM, "vertex"), [*_PRIM, "vertex"], "left_semi").withColumn("slot", F.expr("place * 3 + corner"))
    first = slots.groupBy(*_PRIM, "vertex").agg(F.min("slot").alias("seen"))
    number = (F.row_number().over(Window.partitionBy(*_PRIM).orderBy("seen")) - 1).cast("bigint")
    return slots.join(first.withColumn("local", number).drop("seen"), [*_PRIM, "vertex"]).select(*_PRIM, "slot", "vertex", "local")


def bounds(vertices: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest x, y, z."""
    return vertices.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))))


def resident_cost(primitives: DataFrame) -> DataFrame:
    """Bytes of each primitive's attributes and indices: floats of 4 bytes, indices of 2 where all fit; textures aren't counted.

    primitives: positions, normals, uvs, colors (arrays of arrays) and indices, all but positions nullable.
    """
    some = lambda c, n: F.coalesce(F.size(c), F.lit(0)) * n
    wide = F.when(F.size("positions") > 65536, 4).otherwise(2)
    floats = some("positions", 12) + some("normals", 12) + some("uvs", 8) + some("colors", 16)
    return primitives.withColumn("bytes", (floats + F.coalesce(F.size("indices"), F.lit(0)) * wide).cast("bigint"))
