"""Tile tables derived from the driver's tables.

Each is one SQL text that Spark and DuckDB both read, with tables' names in braces, so both sides of a
comparison start from the same rows.  Coordinates are small integers, so arithmetic on them is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A tree for each region: region, nations, eight groups of each nation's customers, customers.
TILES = """
WITH k AS (SELECT CAST(n.n_regionkey AS BIGINT) AS s, CAST(n.n_nationkey AS BIGINT) AS n, c.c_custkey AS c, c.c_custkey % 8 AS b FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey),
nn AS (SELECT CAST(n_regionkey AS BIGINT) AS s, CAST(n_nationkey AS BIGINT) AS n FROM {nation}),
bb AS (SELECT DISTINCT s, n, b FROM k),
t AS (
SELECT CAST(r_regionkey AS BIGINT) AS set_id, CAST(0 AS BIGINT) AS tile, CAST(NULL AS BIGINT) AS parent, 0 AS depth, CAST(0 AS BIGINT) AS a0, CAST(NULL AS BIGINT) AS a1, CAST(NULL AS BIGINT) AS a2, CAST(NULL AS BIGINT) AS a3,
       512E0 AS geometric_error, 'REPLACE' AS refine, r_regionkey <> 3 AS has_uri, r_regionkey * 4000E0 AS cx, 0E0 AS cy, 0E0 AS cz, 1024E0 AS r, CASE WHEN r_regionkey = 2 THEN 'pending' ELSE 'ready' END AS state, r_regionkey = 4 AS rendered_last, r_regionkey < 2 AS refined_last, false AS culled FROM {region}
UNION ALL
SELECT s, n + 1, 0, 1, 0, n + 1, NULL, NULL, 64E0, CASE WHEN n % 4 = 1 THEN 'ADD' ELSE 'REPLACE' END, true, s * 4000E0 + (n % 5) * 128 - 256, ((n * 7) % 5) * 128E0 - 256, 0E0, 256E0,
       CASE WHEN n % 3 = 0 THEN 'pending' ELSE 'ready' END, n % 6 = 5, n % 2 = 0, n = 11 FROM nn
UNION ALL
SELECT s, 100 + n * 8 + b, n + 1, 2, 0, n + 1, 100 + n * 8 + b, NULL, 8E0, 'REPLACE', b <> 5, s * 4000E0 + (n % 5) * 128 - 256 + (b % 4) * 32 - 48, ((n * 7) % 5) * 128E0 - 256 + (b - b % 4) * 16 - 32, 0E0, 64E0,
       CASE WHEN (n + b) % 4 = 0 THEN 'pending' WHEN (n + b) % 4 = 1 THEN 'failed' ELSE 'ready' END, (n + b) % 3 = 0, (n + b) % 2 = 0, (n + b) % 9 = 0 FROM bb
UNION ALL
SELECT s, 1000 + c, 100 + n * 8 + b, 3, 0, n + 1, 100 + n * 8 + b, 1000 + c, (c % 3) * 8E0, 'REPLACE', c % 11 <> 0, s * 4000E0 + (n % 5) * 128 - 256 + (b % 4) * 32 - 48 + (c * 13) % 64 - 32, ((n * 7) % 5) * 128E0 - 256 + (b - b % 4) * 16 - 32 + (c * 29) % 64 - 32, (c % 16) * 1E0, 4E0 + c % 4,
       CASE WHEN (c * 7) % 10 < 6 THEN 'ready' WHEN (c * 7) % 10 < 9 THEN 'pending' ELSE 'failed' END, c % 5 = 0, false, c % 17 = 0 FROM k)
SELECT set_id, tile, parent, depth, a0, a1, a2, a3, geometric_error, refine, CASE WHEN has_uri THEN concat('t/', CAST(tile AS VARCHAR(20)), '.glb') END AS content_uri, cx, cy, cz, r,
       CASE WHEN has_uri THEN state ELSE 'none' END AS state, rendered_last, refined_last, culled FROM t
"""

PARAMS = """
SELECT CAST(r_regionkey AS BIGINT) AS set_id, r_regionkey * 4000E0 + 96 AS px, 40E0 AS py, 300E0 AS pz, 0E0 AS fx, 0E0 AS fy, -1E0 AS fz,
       512E0 AS k_px, 10E0 AS sse_threshold_px, CASE WHEN r_regionkey = 1 THEN 0E0 ELSE 2000E0 END AS detail_falloff_m, CASE WHEN r_regionkey > 2 THEN 50E0 ELSE 0E0 END AS cam_height_m FROM {region}
"""

#: Resident tiles: one for each order line.
SLOTS = """
SELECT set_id, tile, CASE WHEN f = 'R' THEN 'InFlight' WHEN o = 'O' AND tile % 8 = 7 THEN 'Failed' ELSE 'Ready' END AS state, tile * 10 AS generation, q * 1000 AS bytes, m AS last_touched,
       k % 7 = 0 AS wanted, k % 11 = 0 AS held, k % 2 = 0 AS spawned, k % 3 = 0 AS visible
FROM (SELECT l_suppkey % 8 AS set_id, l_orderkey * 8 + l_linenumber AS tile, max(l_returnflag) AS f, max(l_linestatus) AS o, CAST(max(l_quantity) AS BIGINT) AS q, max(l_partkey) AS k,
       max(CAST(extract(year FROM l_shipdate) AS BIGINT) * 12 + CAST(extract(month FROM l_shipdate) AS BIGINT) - 23900) AS m FROM {lineitem} GROUP BY l_suppkey % 8, l_orderkey * 8 + l_linenumber) x
"""

#: Load requests: one for each event.
REQUESTS = """
SELECT user_id % 8 AS set_id, event_id % 400 AS tile, event_id AS seq, CASE WHEN event_id % 9 <> 0 THEN concat('t/', CAST(event_id AS VARCHAR(20))) END AS content_uri, event_type FROM {events}
"""
REQUEST_SLOTS = """
SELECT s.set_id, t.tile, CASE WHEN t.tile % 5 = 0 THEN CASE WHEN s.set_id % 3 = 0 THEN 'Ready' ELSE 'InFlight' END WHEN t.tile % 13 = 1 THEN 'Failed' ELSE 'NotLoaded' END AS state, s.set_id * 1000 + t.tile AS generation
FROM (SELECT DISTINCT user_id % 8 AS set_id FROM {events}) s CROSS JOIN (SELECT DISTINCT event_id % 400 AS tile FROM {events}) t
"""
CLASSES = "SELECT DISTINCT user_id % 8 AS set_id, CAST((user_id % 8) % 3 AS INT) AS class FROM {events} WHERE user_id % 8 <> 5"
CURSORS = "SELECT CAST(r_regionkey AS INT) AS class, CAST(r_regionkey + 2 AS BIGINT) AS set_id FROM {region} WHERE r_regionkey IN (0, 1)"

BOXES = """
SELECT vec_id, label, CAST(embedding[{first}] AS DOUBLE) AS e0, CAST(embedding[{first} + 1] AS DOUBLE) AS e1, CAST(embedding[{first} + 2] AS DOUBLE) AS e2, CAST(embedding[{first} + 3] AS DOUBLE) AS e3, CAST(embedding[{first} + 4] AS DOUBLE) AS e4,
       CAST(embedding[{first} + 5] AS DOUBLE) AS e5, CAST(embedding[{first} + 6] AS DOUBLE) AS e6, CAST(embedding[{first} + 7] AS DOUBLE) AS e7, CAST(embedding[{first} + 8] AS DOUBLE) AS e8, CAST(embedding[{first} + 9] AS DOUBLE) AS e9,
       CAST(embedding[{first} + 10] AS DOUBLE) AS e10, CAST(embedding[{first} + 11] AS DOUBLE) AS e11 FROM {embeddings}
"""
POINTS = "SELECT s_suppkey AS id, CAST(s_suppkey % 180 AS DOUBLE) - 89.5E0 AS lat, CAST((s_suppkey * 37) % 360 AS DOUBLE) - 180 AS lon, CAST(s_suppkey % 500 AS DOUBLE) AS h FROM {supplier}"
REGIONS = """
SELECT n_nationkey AS id, (n_nationkey % 12) * 0.25E0 - 1.5E0 AS west, (n_nationkey % 9) * 0.125E0 - 0.5E0 AS south, (n_nationkey % 12) * 0.25E0 - 1.5E0 + (n_nationkey % 6) * 0.125E0 - 0.125E0 AS east,
       (n_nationkey % 9) * 0.125E0 - 0.5E0 + (n_nationkey % 5 + 1) * 0.0625E0 AS north, 0E0 AS low, (n_nationkey % 4) * 100E0 AS high FROM {nation}
"""

#: Tileset documents: a root for each region, a child for each nation, their children for its customers.
CUSTOMER_NODES = """
SELECT CAST(n.n_regionkey AS BIGINT) AS set_id, n.n_nationkey AS nation, c.c_custkey AS c FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
"""

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def derived(spark: SparkSession, sf_dir: str, text: str, **more: int) -> DataFrame:
    """A derived table in Spark; only the tables that the text names are opened."""
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in NAMES if "{" + n + "}" in text}
    for k, v in more.items():
        text = text.replace("{" + k + "}", str(v))
    return spark.sql(text, **used)


def duck(text: str, **more: int) -> str:
    return text.format(**{n: n for n in NAMES}, **more)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived trees as the operators take them."""
    return derived(spark, sf_dir, TILES).selectExpr(
        "set_id", "tile", "parent", "depth", "array_compact(array(a0, a1, a2, a3)) AS path", "geometric_error", "refine", "content_uri",
        "named_struct('kind', 'sphere', 'center', array(cx, cy, cz), 'radius', r, 'half_axes', cast(null AS array<double>)) AS volume", "state", "rendered_last", "refined_last", "culled",
    )


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PARAMS).selectExpr("set_id", "array(px, py, pz) AS cam_pos", "array(fx, fy, fz) AS cam_forward", "k_px", "sse_threshold_px", "detail_falloff_m", "cam_height_m")


def _move(x: str) -> str:
    return f"transform(array(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, {x}, 0, 0, 1), v -> cast(v AS double))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, frame, doc): the tileset documents of CUSTOMER_NODES.

    Nodes become text where they are made, and documents are joined from texts: as structures they take several times the memory.
    """
    sphere = lambda x, y, r: f"named_struct('sphere', transform(array({x}, {y}, 0, {r}), v -> cast(v AS double)))"
    joined = lambda key: f"array_join(sort_array(collect_list(struct({key}, text))).text, ',') AS children"
    parent = lambda node: f"concat(regexp_replace(to_json({node}), '[}}]$', ''), ',\"children\":[', coalesce(children, ''), ']}}')"
    leaf = f"named_struct('geometricError', 0, 'boundingVolume', {sphere('c % 64', 'c % 32', '1 + c % 4')}, 'content', named_struct('uri', concat('c/', c, '.glb')))"
    tiles = derived(spark, sf_dir, CUSTOMER_NODES).selectExpr("set_id", "nation", "c", f"to_json({leaf}) AS text").groupBy("set_id", "nation").agg(F.expr(joined("c")))
    nations = derived(spark, sf_dir, "SELECT CAST(n_regionkey AS BIGINT) AS set_id, n_nationkey AS nation FROM {nation}").join(tiles, ["set_id", "nation"], "left")
    branch = f"""named_struct('geometricError', 4, 'boundingVolume', if(nation % 5 = 0, null, {sphere('nation', '0', '128')}), 'refine', if(nation % 4 = 1, 'ADD', null),
      'transform', {_move('nation * 16')}, 'content', if(nation % 3 = 0, named_struct('url', concat('n', nation, '.glb')), null))"""
    sets = nations.selectExpr("set_id", "nation", f"{parent(branch)} AS text").groupBy("set_id").agg(F.expr(joined("nation")))
    root = f"named_struct('geometricError', 64, 'boundingVolume', {sphere('0', '0', '1024')}, 'refine', 'replace', 'transform', {_move('set_id * 4000')})"
    text = f"""concat('{{"asset":{{"version":"1.1"}},"geometricError":64,"root":', {parent(root)}, '}}')"""
    return sets.select("set_id", F.lit("local").alias("frame"), F.parse_json(F.expr(text)).alias("doc"))
