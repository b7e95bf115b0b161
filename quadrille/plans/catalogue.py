"""One query for each family of operators over the derived tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import detail as D
from quadrille.functions import geodesy as G
from quadrille.functions import linear as L
from quadrille.functions import uris as U
from quadrille.functions import volumes as V
from quadrille.operators import geometry, residency, schedule, tree
from quadrille.operators.select import Selection, history, metrics, select
from quadrille.plans import derived as T
from quadrille.tables import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LEVELS = 4


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Selection: the oracle unrolls the passes over the four levels of the derived trees.

_METRICS = f"""m0 AS (SELECT t.*, p.* EXCLUDE (set_id), greatest(0, sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) - r) AS near,
  EXISTS (SELECT 1 FROM t c WHERE c.set_id = t.set_id AND c.parent = t.tile) AS "inner" FROM t JOIN p USING (set_id)),
m1 AS (SELECT *, greatest(near, cam_height_m) AS dist, (cx - px) * (cx - px) + (cy - py) * (cy - py) + (cz - pz) * (cz - pz) AS far FROM m0),
m2 AS (SELECT *, CASE WHEN dist <= 1e-9 THEN 'inf'::DOUBLE ELSE geometric_error * k_px / dist END AS sse, sse_threshold_px * CASE WHEN detail_falloff_m > 0 THEN 1 + greatest(dist - cam_height_m, 0) / detail_falloff_m ELSE 1 END AS threshold,
  2 - CASE WHEN far <= greatest(r * r, 1e-12) THEN 1 ELSE greatest(-1, least(1, ((cx - px) * fx + (cy - py) * fy + (cz - pz) * fz) / sqrt(far))) END AS turn FROM m1),
m3 AS (SELECT *, dist * turn AS key, near * turn AS near_key, state <> 'pending' AS settled, "inner" AND (sse > threshold OR content_uri IS NULL) AS wants FROM m2),
m4 AS (SELECT *, "inner" AND NOT wants AND refined_last AND NOT settled AS protects FROM m3),
m AS (SELECT *, wants OR protects AS refined FROM m4)"""


def _unrolled() -> str:
    parts = [f"WITH t AS ({T.duck(T.TILES)}), p AS ({T.duck(T.PARAMS)}), {_METRICS}", "v0 AS (SELECT * FROM m WHERE depth = 0)"]
    for d in range(1, LEVELS):
        parts.append(f"v{d} AS (SELECT m.* FROM m JOIN v{d - 1} q ON q.set_id = m.set_id AND q.tile = m.parent AND q.refined WHERE m.depth = {d} AND NOT m.culled)")
    for d in range(LEVELS - 1, -1, -1):
        below = f"(SELECT set_id, parent AS tile, bool_and(covered) AS cc, bool_or(any_last) AS ca FROM r{d + 1} GROUP BY ALL)" if d + 1 < LEVELS else "(SELECT NULL::BIGINT AS set_id, NULL::BIGINT AS tile, NULL::BOOLEAN AS cc, NULL::BOOLEAN AS ca)"
        parts.append(f"c{d} AS (SELECT v.*, coalesce(cc, true) AS cc, coalesce(ca, false) AS ca FROM v{d} v LEFT JOIN {below} b ON b.set_id = v.set_id AND b.tile = v.tile)")
        parts.append(f"k{d} AS (SELECT *, CASE WHEN NOT refined THEN 'stop' WHEN refine = 'ADD' THEN 'add' WHEN cc THEN 'covered' WHEN ca THEN 'keep' WHEN state = 'ready' THEN 'swap' ELSE 'drop' END AS fate FROM c{d})")
        parts.append(f"r{d} AS (SELECT * EXCLUDE (cc, ca), CASE WHEN fate IN ('stop', 'add') THEN settled ELSE fate <> 'drop' END AS covered, CASE fate WHEN 'stop' THEN rendered_last WHEN 'add' THEN rendered_last OR ca WHEN 'covered' THEN ca WHEN 'keep' THEN true WHEN 'swap' THEN rendered_last ELSE false END AS any_last FROM k{d})")
    parts.append("h0 AS (SELECT *, false AS hidden FROM r0)")
    for d in range(1, LEVELS):
        parts.append(f"h{d} AS (SELECT r.*, q.hidden OR q.fate IN ('swap', 'drop') AS hidden FROM r{d} r JOIN h{d - 1} q ON q.set_id = r.set_id AND q.tile = r.parent)")
    whole = " UNION ALL ".join(f"SELECT * FROM h{d}" for d in range(LEVELS))
    parts.append(f"w AS (SELECT *, NOT hidden AND state = 'ready' AND fate IN ('stop', 'add', 'swap') AS render FROM ({whole}))")
    return ",\n".join(parts)


_SELECTED = _unrolled()
_PATH = "list_filter([a0, a1, a2, a3], lambda x: x IS NOT NULL)"
_LOADS = _SELECTED + f""",
ask AS (
SELECT set_id, tile, content_uri, CASE WHEN dist <= 1e-9 THEN 0 ELSE 2 END AS priority, key, list_append({_PATH}, -2) AS emitted FROM w WHERE state = 'pending' AND protects
UNION ALL SELECT set_id, tile, content_uri, CASE WHEN dist <= 1e-9 THEN 0 WHEN fate = 'stop' AND NOT "inner" AND sse > threshold THEN 1 ELSE 2 END, key, list_append({_PATH}, -1) FROM w WHERE state = 'pending' AND fate IN ('stop', 'add')
UNION ALL SELECT set_id, tile, content_uri, CASE WHEN dist <= 1e-9 THEN 0 ELSE 2 END, key, list_append({_PATH}, 4611686018427387903) FROM w WHERE state = 'pending' AND fate = 'keep'
UNION ALL SELECT set_id, tile, content_uri, 0, key, list_append({_PATH}, 4611686018427387903) FROM w WHERE state = 'pending' AND fate = 'drop'),
up AS (SELECT set_id, unnest({_PATH}[:-2]) AS tile, {_PATH} AS path FROM w WHERE render),
pre AS (SELECT set_id, tile, min(path) AS path FROM up GROUP BY ALL),
ld AS (SELECT * FROM ask UNION ALL
SELECT w.set_id, w.tile, w.content_uri, 3, near_key, list_concat([4611686018427387904], list_append(pre.path, -w.depth)) FROM w JOIN pre ON pre.set_id = w.set_id AND pre.tile = w.tile WHERE state = 'pending' AND NOT EXISTS (SELECT 1 FROM ask WHERE ask.set_id = w.set_id AND ask.tile = w.tile))"""


def _selection(spark: SparkSession, sf_dir: str) -> Selection:
    return select(T.tiles(spark, sf_dir), T.params(spark, sf_dir), LEVELS)


@_query(_SELECTED + " SELECT set_id, tile, CAST(depth AS INT) AS depth FROM w WHERE render")
def q_select_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the tiles that each set shows."""
    return _selection(spark, sf_dir).nodes.where("render").select("set_id", "tile", "depth")


@_query(_SELECTED + " SELECT set_id, tile, refined, render, covered, any_last, fate FROM w")
def q_select_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile that selection visits, and what became of it."""
    return _selection(spark, sf_dir).nodes.where("touched").selectExpr("set_id", "tile", "refined", "render", "covered", "any_last", "case AS fate")


@_query(_LOADS + " SELECT set_id, tile, CAST(priority AS INT) AS priority, key, row_number() OVER (PARTITION BY set_id ORDER BY priority, key, emitted) - 1 AS seq FROM ld")
def q_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each set asks to be loaded, in its order."""
    return _selection(spark, sf_dir).loads.select("set_id", "tile", "priority", "key", "seq")


@_query(_SELECTED + " SELECT t.set_id, t.tile, coalesce(w.render, false) AS rendered_last, coalesce(w.refined, false) AS refined_last FROM t LEFT JOIN w ON w.set_id = t.set_id AND w.tile = t.tile")
def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next frame knows of this one."""
    return history(_selection(spark, sf_dir))


@_query(_SELECTED + " SELECT set_id, tile, wants, protects, refined FROM w")
def q_select_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visited tile, whether it is refined, and why."""
    measured = metrics(T.tiles(spark, sf_dir), T.params(spark, sf_dir)).select("set_id", "tile", "wants", "protects")
    return _selection(spark, sf_dir).nodes.where("touched").select("set_id", "tile", "refined").join(measured, ["set_id", "tile"]).select("set_id", "tile", "wants", "protects", "refined")


@_query(_SELECTED + " SELECT set_id, tile, refined, render, covered FROM w WHERE refine = 'ADD'")
def q_add_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visited tiles that stay beside their children, and whether they are shown."""
    return _selection(spark, sf_dir).nodes.where("touched AND refine = 'ADD'").select("set_id", "tile", "refined", "render", "covered")


@_query(_SELECTED + " SELECT set_id, tile FROM w WHERE protects")
def q_zoom_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles refined only because they were, and their own content isn't there yet."""
    s = _selection(spark, sf_dir)
    return s.nodes.where("touched").join(metrics(T.tiles(spark, sf_dir), T.params(spark, sf_dir)).where("protects").select("set_id", "tile"), ["set_id", "tile"], "left_semi").select("set_id", "tile")


@_query(_SELECTED + " SELECT set_id, count(*) AS tiles, min(depth)::INT AS min_depth, max(depth)::INT AS max_depth FROM w WHERE render GROUP BY set_id")
def q_cut_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residency.cut_shape(_selection(spark, sf_dir).nodes)


_M = f"WITH t AS ({T.duck(T.TILES)}), p AS ({T.duck(T.PARAMS)}), {_METRICS}"


@_query(_M + " SELECT set_id, tile, dist, sse, threshold, wants FROM m")
def q_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(T.tiles(spark, sf_dir), T.params(spark, sf_dir)).select("set_id", "tile", "dist", "sse", "threshold", "wants")


@_query(_M + " SELECT set_id, tile, key, near_key FROM m")
def q_load_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(T.tiles(spark, sf_dir), T.params(spark, sf_dir)).select("set_id", "tile", "key", "near_key")


_PLANES = [(1, 0, 0, 200), (-1, 0, 0, 8600), (0, 1, 0, 150), (0, -1, 0, 220), (0, 0, -1, 600)]


@_query(f"SELECT set_id, tile FROM ({T.duck(T.TILES)}) WHERE " + " AND ".join(f"{a} * cx + {b} * cy + {c} * cz + {d} > -(r * 1.25)" for a, b, c, d in _PLANES))
def q_frustum_cull(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = "array(" + ", ".join(f"array({a}D, {b}D, {c}D, {d}D)" for a, b, c, d in _PLANES) + ")"
    return T.tiles(spark, sf_dir).where(V.in_frustum("volume", planes)).select("set_id", "tile")


# Trees.


@_query(f"SELECT set_id, tile, unnest({_PATH}[:-2]) AS ancestor FROM ({T.duck(T.TILES)})")
def q_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.above(T.tiles(spark, sf_dir)).select("set_id", "tile", F.element_at("up", -1).alias("ancestor"))


@_query(f"SELECT set_id, tile, CAST(row_number() OVER (PARTITION BY set_id ORDER BY {_PATH}) - 1 AS BIGINT) AS preorder FROM ({T.duck(T.TILES)})")
def q_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.tiles(spark, sf_dir).withColumnRenamed("tile", "was").drop("parent")
    return tree.numbered(nodes).selectExpr("set_id", "was AS tile", "tile AS preorder")


@_query(f"WITH t AS ({T.duck(T.TILES)}), k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY tile) - 1 AS num FROM t WHERE NOT (depth = 3 AND tile % 3 = 0)) SELECT k.set_id, k.num AS tile, q.num AS parent, k.tile AS was FROM k LEFT JOIN k q ON q.set_id = k.set_id AND q.tile = k.parent")
def q_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.retain(T.tiles(spark, sf_dir), F.expr("NOT (depth = 3 AND tile % 3 = 0)")).select("set_id", "tile", "parent", "was")


_GRAFTED = "depth = 2 AND tile % 3 = 0"
_STALE_SLOT = "CASE WHEN tile % 97 = 3 THEN 'Ready' WHEN tile % 89 = 7 THEN 'InFlight' ELSE 'NotLoaded' END AS state, tile % 700 AS last_touched"


@_query(f"""WITH t AS ({T.duck(T.TILES)}), s AS (SELECT set_id, tile, {_STALE_SLOT} FROM t), g AS (SELECT set_id, parent AS host, tile AS child_root, concat('g/', tile) AS uri FROM t WHERE {_GRAFTED}),
x AS (SELECT g.set_id, g.host, g.child_root, g.uri FROM g JOIN s ON s.set_id = g.set_id AND s.tile = g.child_root WHERE greatest(1000 - s.last_touched, 0) > 600
 AND NOT EXISTS (SELECT 1 FROM t JOIN s USING (set_id, tile) WHERE t.set_id = g.set_id AND (t.tile = g.child_root OR t.parent = g.child_root) AND s.state IN ('Ready', 'InFlight'))),
k AS (SELECT t.*, row_number() OVER (PARTITION BY t.set_id ORDER BY t.tile) - 1 AS num FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.set_id = t.set_id AND (x.child_root = t.tile OR x.child_root = t.parent)))
SELECT k.set_id, k.num AS tile, k.tile AS was, coalesce((SELECT max(uri) FROM x WHERE x.set_id = k.set_id AND x.host = k.tile), k.content_uri) AS content_uri FROM k""")
def q_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.tiles(spark, sf_dir)
    slots = nodes.selectExpr("set_id", "tile", *_STALE_SLOT.split(", "))
    grafts = nodes.where(_GRAFTED).selectExpr("set_id", "parent AS at", "tile AS child_root", "concat('g/', tile) AS uri")
    return tree.compact(nodes.select("set_id", "tile", "parent", "path", "content_uri"), slots, grafts, 1000, 600).select("set_id", "tile", "was", "content_uri")


# Residency.

_S = f"WITH s AS ({T.duck(T.SLOTS)})"


@_query(_S + """, a AS (SELECT sum(CASE WHEN state = 'Ready' THEN bytes END)::BIGINT AS resident, count(*) FILTER (state = 'InFlight') AS in_flight FROM s)
SELECT resident, in_flight, least(8, CASE WHEN resident <= 300000000 THEN 1 ELSE least(8, resident::DOUBLE / 300000000) END * 1.25)::DOUBLE AS pressure, greatest(16000 - in_flight, 0) AS free, resident > (300000000 * 3) // 2 AS halted FROM a""")
def q_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residency.load_state(T.derived(spark, sf_dir, T.SLOTS), 300_000_000, 1.25, 16000)


_GRACE, _FRAME, _MOST = 20, 80, 1500
_STALE = f"state = 'Ready' AND NOT wanted AND NOT held AND greatest({_FRAME} - last_touched, 0) > {_GRACE}"


@_query(_S + f" SELECT set_id, tile FROM s WHERE {_STALE}")
def q_evict_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residency.stale(T.derived(spark, sf_dir, T.SLOTS), _FRAME, _GRACE).select("set_id", "tile")


@_query(_S + f""", l AS (SELECT * FROM s WHERE state = 'Ready' AND NOT ({_STALE})), o AS (SELECT set_id, count(*) - {_MOST} AS over FROM l GROUP BY set_id),
x AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY last_touched, tile) AS k FROM l WHERE NOT wanted AND NOT held) SELECT set_id, tile FROM x JOIN o USING (set_id) WHERE k <= over""")
def q_evict_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residency.overflow(T.derived(spark, sf_dir, T.SLOTS), _FRAME, _GRACE, _MOST).select("set_id", "tile")


_TILE_SLOTS = "set_id, tile, CASE WHEN state = 'ready' THEN 'Ready' ELSE 'NotLoaded' END AS state, tile % 5 <> 0 AS spawned, (tile % 7) * (tile % 7) < 9 AS visible, tile % 43 = 0 OR tile % 31 = 5 AS wanted"
_HOLD = f"""WITH t AS ({T.duck(T.TILES)}), s AS (SELECT {_TILE_SLOTS} FROM t), c AS (SELECT set_id, tile, unnest({_PATH}[:-2]) AS up FROM t),
st AS (SELECT set_id, tile FROM s WHERE wanted AND state = 'Ready' AND NOT spawned),
h AS (SELECT c.set_id, up AS tile FROM c JOIN st USING (set_id, tile) UNION SELECT c.set_id, c.tile FROM c JOIN st ON st.set_id = c.set_id AND st.tile = c.up)"""


@_query(_HOLD + " SELECT set_id, tile FROM h")
def q_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = T.tiles(spark, sf_dir)
    return residency.hold(nodes, nodes.selectExpr(*_TILE_SLOTS.split(", ")))


@_query(_HOLD + " SELECT DISTINCT c.set_id, c.tile FROM c JOIN s ON s.set_id = c.set_id AND s.tile = c.tile AND s.wanted JOIN s a ON a.set_id = c.set_id AND a.tile = c.up AND a.state = 'Ready' AND a.spawned AND a.visible AND NOT a.wanted JOIN h ON h.set_id = c.set_id AND h.tile = c.up")
def q_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = written(T.tiles(spark, sf_dir))
    slots = nodes.selectExpr(*_TILE_SLOTS.split(", "))
    return residency.covered_by_coarser(nodes, slots, residency.hold(nodes, slots))


@_query(f"SELECT set_id, tile FROM (SELECT {_TILE_SLOTS} FROM ({T.duck(T.TILES)})) WHERE state = 'Ready' AND wanted AND NOT spawned ORDER BY set_id, tile LIMIT 8")
def q_respawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residency.respawned(T.tiles(spark, sf_dir).selectExpr(*_TILE_SLOTS.split(", ")), 8).select("set_id", "tile")


# Scheduling.

_C = f"""WITH q AS ({T.duck(T.REQUESTS)}), s AS ({T.duck(T.REQUEST_SLOTS)}), cl AS ({T.duck(T.CLASSES)}), cu AS ({T.duck(T.CURSORS)}),
o AS (SELECT q.* FROM q JOIN s USING (set_id, tile) WHERE s.state = 'NotLoaded' AND content_uri IS NOT NULL),
rd AS (SELECT set_id, bool_or(state = 'Ready') AS has_ready FROM s GROUP BY set_id),
w AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY seq) - 1 AS within FROM o),
c AS (SELECT w.set_id, w.tile, coalesce(cl.class, 0)::INT AS class, within = 0 AND NOT has_ready AS starving_root, within FROM w JOIN rd USING (set_id) LEFT JOIN cl USING (set_id)),
k AS (SELECT c.*, row_number() OVER (PARTITION BY c.set_id, c.tile ORDER BY NOT starving_root, c.class, within) AS nth, coalesce(c.set_id <= cu.set_id, true) AS wrapped FROM c LEFT JOIN cu ON cu.class = c.class),
g AS (SELECT *, row_number() OVER (ORDER BY NOT starving_root, class, within, wrapped, set_id) - 1 AS "grant" FROM k WHERE nth = 1 QUALIFY "grant" < 24)"""


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    get = lambda text: T.derived(spark, sf_dir, text)
    return schedule.candidates(get(T.REQUESTS), get(T.REQUEST_SLOTS), get(T.CLASSES)), get(T.CURSORS)


@_query(_C + " SELECT * FROM c")
def q_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)[0]


@_query(_C + ' SELECT set_id, tile, class, within, starving_root, "grant" FROM g')
def q_topk_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.admit(*_candidates(spark, sf_dir), 24)


@_query(_C + ', n AS (SELECT class, max_by(set_id, "grant") AS set_id FROM g GROUP BY class) SELECT * FROM n UNION ALL SELECT class, set_id FROM cu WHERE class NOT IN (SELECT class FROM n)')
def q_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands, cursors = _candidates(spark, sf_dir)
    return schedule.advanced(cursors, schedule.admit(cands, cursors, 24))


_PAYLOADS = "SELECT user_id % 8 AS set_id, event_id % 400 AS tile, (user_id % 8) * 1000 + event_id % 400 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS generation, event_id FROM {events}"


@_query(f"SELECT p.* FROM ({T.duck(_PAYLOADS)}) p JOIN ({T.duck(T.REQUEST_SLOTS)}) s USING (set_id, tile, generation) WHERE s.state = 'InFlight'")
def q_generation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.landed(T.derived(spark, sf_dir, _PAYLOADS), T.derived(spark, sf_dir, T.REQUEST_SLOTS)).select("set_id", "tile", "generation", "event_id")


@_query(f"SELECT s.set_id, s.tile, s.generation FROM ({T.duck(T.REQUEST_SLOTS)}) s WHERE s.state = 'InFlight' AND NOT EXISTS (SELECT 1 FROM events WHERE user_id % 8 = s.set_id AND event_id % 400 = s.tile AND event_type = 'click')")
def q_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = T.derived(spark, sf_dir, T.REQUESTS).where("event_type = 'click'").select("set_id", "tile").distinct()
    return schedule.aborted(T.derived(spark, sf_dir, T.REQUEST_SLOTS), wanted).select("set_id", "tile", "generation")


@_query("SELECT event_id FROM events WHERE event_id <= (SELECT max(event_id) FROM (SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY event_id LIMIT 50))")
def q_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = T.derived(spark, sf_dir, "SELECT event_id AS seq, event_type <> 'error' AS lands FROM {events}")
    return schedule.bounded_intake(messages, 50).selectExpr("seq AS event_id")


@_query("SELECT event_type, count(*) AS tiles, sum(a)::BIGINT AS ms_0, sum(b)::BIGINT AS ms_1, max(a + b) AS worst_ms, sum(a) / count(*) AS avg_0 FROM (SELECT event_type, CAST(event_id % 17 AS DOUBLE) AS a, CAST(event_id % 5 AS DOUBLE) AS b FROM events) GROUP BY event_type")
def q_decode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, "SELECT event_type, array(CAST(event_id % 17 AS DOUBLE), CAST(event_id % 5 AS DOUBLE), 0E0, 0E0) AS stage_ms FROM {events}")
    return schedule.decode_stats(rows, "event_type").selectExpr("event_type", "tiles", "cast(ms_0 AS bigint) AS ms_0", "cast(ms_1 AS bigint) AS ms_1", "worst_ms", "avg_0")


_LINES = "SELECT label_ AS k, concat(source, ' ; ', lang, ';;', CAST(n_chars % 7 AS VARCHAR(9))) AS line FROM (SELECT doc_id % 10 AS label_, source, coalesce(lang, '') AS lang, n_chars FROM {documents})"


@_query(f"SELECT k, list_sort(list(DISTINCT trim(l))) AS credits FROM (SELECT k, unnest(string_split(line, ';')) AS l FROM ({T.duck(_LINES)})) WHERE trim(l) <> '' GROUP BY k")
def q_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.credits(T.derived(spark, sf_dir, _LINES), "line", "k")


# Geodesy, volumes and matrices.


@_query("SELECT id, round(x, 3) + 0 AS x, round(y, 3) + 0 AS y, round((n * (1 - e) + h) * sin(radians(lat)), 3) AS z FROM (SELECT *, (n + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y FROM "
        f"(SELECT *, {G.ECC2!r} AS e, 6378137.0::DOUBLE / sqrt(1 - {G.ECC2!r} * sin(radians(lat)) * sin(radians(lat))) AS n FROM ({T.duck(T.POINTS)})))")  # fmt: skip
def q_geodetic_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.derived(spark, sf_dir, T.POINTS).withColumn("p", F.expr(G.ecef("lat", "lon", "h"))).selectExpr("id", "round(p[0], 3) + 0D AS x", "round(p[1], 3) + 0D AS y", "round(p[2], 3) AS z")


@_query(f"""WITH r AS ({T.duck(T.REGIONS)}), u AS (SELECT *, east - west > 0 AND east - west <= 0.5 AND north - south > 0 AND north - south <= 0.5 AS usable, (south + north) * 0.5 AS la, (west + east) * 0.5 AS lo FROM r),
g AS (SELECT u.*, south + (north - south) * i / 2 AS a, west + (east - west) * j / 2 AS o, CASE WHEN k = 0 THEN low ELSE high END AS h FROM u, range(3) i(i), range(3) j(j), range(2) k(k)),
x AS (SELECT *, 6378137 / sqrt(1 - {G.ECC2!r} * sin(a) * sin(a)) AS n, 6378137 / sqrt(1 - {G.ECC2!r} * sin(la) * sin(la)) AS n0 FROM g),
d AS (SELECT *, n0 * cos(la) * cos(lo) AS x0, n0 * cos(la) * sin(lo) AS y0, n0 * (1 - {G.ECC2!r}) * sin(la) AS z0, (n + h) * cos(a) * cos(o) AS px, (n + h) * cos(a) * sin(o) AS py, (n * (1 - {G.ECC2!r}) + h) * sin(a) AS pz FROM x),
q AS (SELECT *, -sin(lo) * (px - x0) + cos(lo) * (py - y0) AS e, -sin(la) * cos(lo) * (px - x0) - sin(la) * sin(lo) * (py - y0) + cos(la) * (pz - z0) AS nn, cos(la) * cos(lo) * (px - x0) + cos(la) * sin(lo) * (py - y0) + sin(la) * (pz - z0) AS up FROM d),
b AS (SELECT id, any_value(usable) AS usable, any_value(high) AS high, any_value(la) AS la, any_value(lo) AS lo, any_value(x0) AS x0, min(e) AS e0, max(e) AS e1, min(nn) AS n0, max(nn) AS n1, min(up) AS u0, max(up) AS u1 FROM q GROUP BY id)
SELECT id, CASE WHEN usable THEN 'obb' ELSE 'sphere' END AS kind, CASE WHEN usable THEN round(x0 - sin(lo) * (e0 + e1) * 0.5 - sin(la) * cos(lo) * (n0 + n1) * 0.5 + cos(la) * cos(lo) * (u0 + u1) * 0.5, 2) ELSE 0 END AS cx,
CASE WHEN usable THEN round(sqrt((e1 - e0) * (e1 - e0) + (n1 - n0) * (n1 - n0) + (u1 - u0) * (u1 - u0)) / 2, 2) ELSE 6378137 + greatest(high, 0) END AS radius FROM b""")
def q_region_obb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, T.REGIONS).withColumn("v", F.expr(G.region_volume("array(west, south, east, north, low, high)")))
    return rows.selectExpr("id", "v.kind AS kind", "if(v.kind = 'obb', round(v.center[0], 2), 0D) AS cx", f"if(v.kind = 'obb', round({V.bounding_radius('v')}, 2), v.radius) AS radius")


@_query("SELECT n_nationkey AS id, n_nationkey % 5 = 0 OR sqrt((n_nationkey * 200000.0::DOUBLE) * (n_nationkey * 200000.0::DOUBLE) + 25.0::DOUBLE) > 2000000 AS georeferenced FROM nation")
def q_georef(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, "SELECT n_nationkey AS id FROM {nation}").selectExpr("id", "if(id % 5 = 0, array(0D), null) AS region", "array(0D, 5D, 0D) AS center", f"if(id % 2 = 0, {L.translation('array(id * 200000D, 0D, 0D)')}, array(1D,0D,0D,0D, 0D,1D,0D,0D, 0D,0D,1D,0D, id * 200000D,0D,0D,1D)) AS m")
    return rows.selectExpr("id", f"{G.georeferenced('region', 'center', 'm')} AS georeferenced")


_MAT = "[((i * 7 + n_nationkey) % 11 - 5)::DOUBLE for i in range(16)]"


@_query(f"SELECT id, unnest(range(16)) AS i, unnest([a[i % 4 + 1] * b[i - i % 4 + 1] + a[i % 4 + 5] * b[i - i % 4 + 2] + a[i % 4 + 9] * b[i - i % 4 + 3] + a[i % 4 + 13] * b[i - i % 4 + 4] for i in range(16)]) AS v FROM (SELECT n_nationkey AS id, {_MAT} AS a, {_MAT.replace('* 7', '* 5')} AS b FROM nation)")
def q_mat4_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, "SELECT n_nationkey AS id FROM {nation}").selectExpr("id", "transform(sequence(0, 15), i -> cast((i * 7 + id) % 11 - 5 AS double)) AS a", "transform(sequence(0, 15), i -> cast((i * 5 + id) % 11 - 5 AS double)) AS b")
    return rows.select("id", F.posexplode(F.expr(L.multiply("a", "b"))).alias("i", "v")).select("id", F.col("i").cast("bigint").alias("i"), "v")


def _share(k: int) -> str:
    a = [f"e{3 + 3 * k + i}" for i in range(3)]
    size = f"sqrt({' + '.join(f'{x} * {x}' for x in a)})"
    return f"CASE WHEN {size} < 1e-12 THEN 0 ELSE greatest(-1, least(1, ({' + '.join(f'(0.5 - e{i}) * {x}' for i, x in enumerate(a))}) / ({size} * {size}))) END"


@_query(f"WITH b AS (SELECT *, {', '.join(f'{_share(k)} AS s{k}' for k in range(3))} FROM ({T.duck(T.BOXES, first=1)})), l AS (SELECT *, {', '.join(f'0.5 - e{i} - e{3 + i} * s0 - e{6 + i} * s1 - e{9 + i} * s2 AS l{i}' for i in range(3))} FROM b) "
        f"SELECT vec_id, round(sqrt(l0 * l0 + l1 * l1 + l2 * l2), 6) AS dist, round(sqrt({' + '.join(f'e{k} * e{k}' for k in range(3, 12))}), 6) AS radius FROM l")  # fmt: skip
def q_volume_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, T.BOXES, first=0).selectExpr("vec_id", V.obb("array(e0, e1, e2)", "array(e3, e4, e5, e6, e7, e8, e9, e10, e11)") + " AS v", "array(0.5D, 0.5D, 0.5D) AS p")
    return rows.selectExpr("vec_id", f"round({V.distance('v', 'p')}, 6) AS dist", f"round({V.bounding_radius('v')}, 6) AS radius")


# Archives, URIs and content.

_URLS = "SELECT page_id, url FROM {pages}"


@_query("SELECT page_id, md5(url) AS hash, concat(" + ", ".join(f"substring(md5(url), {2 * k - 1}, 2)" for k in (*range(8, 0, -1), *range(16, 8, -1))) + ") AS sort_key FROM (SELECT page_id, ltrim(replace(concat('/', url), '\\', '/'), '/') AS url FROM pages)")
def q_md5_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, _URLS).withColumn("url", F.expr("concat('/', url)")).withColumn("h", F.expr(U.path_hash("url")))
    return rows.selectExpr("page_id", "lower(hex(h)) AS hash", f"lower(hex({U.sort_key('h')})) AS sort_key")


@_query("SELECT a.page_id, b.page_id AS entry FROM pages a JOIN pages b ON md5(a.url) = md5(b.url) AND a.url = b.url")
def q_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, _URLS).withColumn("hash", F.expr(U.path_hash("url")))
    index = rows.select("hash", F.col("page_id").alias("entry"), F.col("url").alias("name"))
    return rows.join(index, "hash").where(F.expr(f"{U.normalized('url')} = {U.normalized('name')}")).select("page_id", "entry")


@_query("SELECT set_id, start, CASE WHEN span <= 67108864 THEN span END AS span FROM (SELECT set_id, start, lead(start) OVER (PARTITION BY set_id ORDER BY start) - start AS span FROM (SELECT DISTINCT l_suppkey % 16 AS set_id, l_orderkey * 8 + l_linenumber AS start FROM lineitem))")
def q_entry_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrille.sources.archive import spans

    rows = T.derived(spark, sf_dir, "SELECT DISTINCT l_suppkey % 16 AS set_id, l_orderkey * 8 + l_linenumber AS start FROM {lineitem}")
    return spans(rows, "set_id", "start")


@_query(r"""SELECT page_id, regexp_extract(url, '^[^?#]*') LIKE '%.3tz' AS is_archive, nullif(regexp_extract(regexp_extract(url, '^[^?#]*'), '^.*/'), '') AS directory, regexp_matches(url, '\?(.*&)?ref=') AS has_ref,
nullif(regexp_extract(url, '\?(?:[^#]*&)?session=([^&#]*)', 1), '') AS session, concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'key=K', '&session=T') AS entry_url, concat(rtrim(regexp_extract(url, '^[^?]*'), '/'), '/tile.glb') AS cache_key FROM pages""")
def q_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.derived(spark, sf_dir, _URLS).selectExpr(
        "page_id", f"{U.is_archive('url')} AS is_archive", f"{U.directory('url')} AS directory", f"{U.has_parameter('url', 'ref')} AS has_ref", f"{U.session('url')} AS session",
        f"{U.entry_url(repr('https://h.example/root.json'), 'url', repr('K'), repr('T'))} AS entry_url", f"{U.cache_key(repr('exploded'), 'url', repr('/tile.glb'))} AS cache_key",
    )


_MESSAGES = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'archive' ELSE 'http' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'connection reset' ELSE concat('status ', CAST(n_chars % 600 AS VARCHAR(9)), ' for x') END AS message FROM {documents}"


@_query(f"SELECT doc_id, code, kind = 'http' AND (code IS NULL OR code BETWEEN 500 AND 599 OR code IN (408, 429)) AS transient FROM (SELECT *, TRY_CAST(nullif(regexp_extract(message, 'status ([0-9]*)', 1), '') AS INT) AS code FROM ({T.duck(_MESSAGES)}))")
def q_transient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.derived(spark, sf_dir, _MESSAGES).selectExpr("doc_id", f"{U.status_code('message')} AS code", f"{U.transient('kind', 'message')} AS transient")


_JSON = "SELECT page_id, concat(CASE WHEN page_id % 4 = 0 THEN ' {\"geometricError\": 1, \"root\": {}}' ELSE '{}' END, CASE page_id % 9 WHEN 1 THEN 'KHR_draco_mesh_compression' WHEN 2 THEN 'CESIUM_RTC' WHEN 3 THEN 'EXT_meshopt_compression\"images\"' WHEN 5 THEN '\"textures\"' ELSE '' END, html) AS text FROM {pages}"


@_query("SELECT page_id, contains(text, 'KHR_draco_mesh_compression') AS draco, v AS vanilla, regexp_matches(text, '^\\s*\\{') AND contains(text, '\"geometricError\"') AND contains(text, '\"root\"') AS tileset, d AS declines, d AND (contains(text, '\"images\"') OR contains(text, '\"textures\"') OR contains(text, '\"extensionsRequired\"') OR contains(text, 'KHR_draco_mesh_compression') OR contains(text, 'KHR_gaussian_splatting')) AS extract_declines FROM (SELECT *, contains(text, 'KHR_draco_mesh_compression') OR contains(text, 'KHR_gaussian_splatting') OR (page_id % 2 = 1 AND v) AS d FROM (SELECT *, NOT ("
        + " OR ".join(f"contains(text, '{m}')" for m in U.MARKERS.values()) + ") AS v FROM (" + _JSON.replace("{pages}", "pages") + ")))")
def q_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    head = "concat(if(page_id % 4 = 0, ' {\"geometricError\": 1, \"root\": {}}', '{}'), CASE page_id % 9 WHEN 1 THEN 'KHR_draco_mesh_compression' WHEN 2 THEN 'CESIUM_RTC' WHEN 3 THEN 'EXT_meshopt_compression\"images\"' WHEN 5 THEN '\"textures\"' ELSE '' END, html)"
    return pages.selectExpr("page_id", f"{head} AS text").selectExpr("page_id", f"{U.marker('text', 'draco')} AS draco", f"{U.vanilla('text')} AS vanilla", f"{U.looks_like_tileset('text')} AS tileset", f"{U.prepare_declines('text', 'page_id % 2 = 0')} AS declines", f"{U.extract_declines('text', 'page_id % 2 = 0')} AS extract_declines")


# Tileset documents and archives.

#: The documents' tiles by the keys that they come from; paths number the children of each tile from 0.
_DOC_TILES = f"""c AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY c) - 1 AS j FROM ({T.duck(T.CUSTOMER_NODES)})),
n AS (SELECT CAST(n_regionkey AS BIGINT) AS set_id, n_nationkey AS nation, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
t AS (SELECT set_id, [0] AS path, 0 AS depth, 'REPLACE' AS refine, NULL AS content_uri, set_id * 4000.0 AS x, 0.0 AS y, 1024.0 AS r, set_id * 4000.0 AS moved FROM (SELECT DISTINCT set_id FROM n)
UNION ALL SELECT set_id, [0, i], 1, CASE WHEN nation % 4 = 1 THEN 'ADD' ELSE 'REPLACE' END, CASE WHEN nation % 3 = 0 THEN concat('n', nation, '.glb') END, set_id * 4000.0 + CASE WHEN nation % 5 = 0 THEN 0 ELSE nation * 17 END, 0.0, CASE WHEN nation % 5 = 0 THEN 1024.0 ELSE 128.0 END, set_id * 4000.0 + nation * 16 FROM n
UNION ALL SELECT c.set_id, [0, i, j], 2, CASE WHEN nation % 4 = 1 THEN 'ADD' ELSE 'REPLACE' END, concat('c/', c, '.glb'), c.set_id * 4000.0 + nation * 16 + c % 64, c % 32 * 1.0, 1.0 + c % 4, c.set_id * 4000.0 + nation * 16 FROM c JOIN n USING (nation)),
k AS (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY path) - 1 AS tile FROM t)"""


@_query(f"WITH {_DOC_TILES} SELECT k.set_id, k.tile, p.tile AS parent, k.depth, k.refine, k.content_uri, k.x::DOUBLE AS x, k.y::DOUBLE AS y, k.r::DOUBLE AS radius, k.moved::DOUBLE AS moved FROM k LEFT JOIN k p ON p.set_id = k.set_id AND len(k.path) > 1 AND p.path = k.path[:-2]")
def q_tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as trees: depth-first numbers, parents, composed matrices, inherited refinement and volumes."""
    rows = tree.build(T.documents(spark, sf_dir))
    return rows.selectExpr("set_id", "tile", "parent", "depth", "refine", "content_uri", "volume.center[0] AS x", "volume.center[1] AS y", "volume.radius AS radius", "world_from_tile[12] AS moved")


_EXTERNAL = '{"asset": {"version": "1.1"}, "geometricError": 2, "root": {"geometricError": 2, "boundingVolume": {"sphere": [1, 2, 0, 3]}, "children": [{"geometricError": 0, "content": {"uri": "x.glb"}}]}}'


@_query(f"""WITH {_DOC_TILES}, h AS (SELECT set_id, tile AS host, row_number() OVER (PARTITION BY set_id ORDER BY tile) - 1 AS g, depth, refine, moved, content_uri FROM k WHERE content_uri LIKE 'c/%7.glb'),
s AS (SELECT set_id, count(*) AS size FROM k GROUP BY set_id)
SELECT set_id, tile, depth, refine, CASE WHEN content_uri LIKE 'c/%7.glb' THEN NULL ELSE content_uri END AS content_uri, x::DOUBLE AS x, NULL::BIGINT AS host FROM k
UNION ALL SELECT set_id, size + 2 * g + below, depth + 1 + below, refine, CASE WHEN below = 1 THEN 'c/x.glb' END, moved + 1, host + CASE WHEN below = 1 THEN size + 2 * g - host ELSE 0 END FROM h JOIN s USING (set_id), (VALUES (0), (1)) b(below)""")
def q_graft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grafted below other documents' tiles, and what their tiles hang on."""
    nodes = written(tree.build(T.documents(spark, sf_dir)))
    at = nodes.where("content_uri like 'c/%7.glb'").selectExpr("set_id", "tile AS at", "'local' AS frame", f"parse_json('{_EXTERNAL}') AS doc")
    size = nodes.groupBy("set_id").agg(F.count("*").alias("size"))
    return tree.graft(nodes, at).join(size, "set_id").selectExpr("set_id", "tile", "depth", "refine", "content_uri", "volume.center[0] AS x", "if(tile >= size, parent, null) AS host")


@_query("SELECT CAST(page_id % 7 AS VARCHAR) AS archive, concat('p/', page_id, '.html') AS path, md5(html) AS digest, CAST(strlen(html) AS BIGINT) AS bytes FROM pages WHERE html IS NOT NULL")
def q_3tz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages packed into archives, every other one deflated, and read back."""
    from quadrille.sources.archive import read_archives, write_archives

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null")
    packed = write_archives(pages.selectExpr("cast(page_id % 7 AS string) AS archive", "concat('p/', page_id, '.html') AS path", "cast(html AS binary) AS data", "page_id % 2 = 0 AS deflate"))
    return read_archives(packed.selectExpr("archive AS path", "content")).selectExpr("archive", "path", "md5(data) AS digest", "cast(octet_length(data) AS bigint) AS bytes")


# Geometry.

_TRI = "SELECT tile, CAST(0 AS BIGINT) AS mesh, CAST(0 AS BIGINT) AS prim, triangle, k % 50 AS v0, (k + 1) % 53 AS v1, (k * 3) % 57 AS v2 FROM (SELECT l_suppkey % 10 AS tile, l_orderkey * 8 + l_linenumber AS triangle, max(l_partkey) AS k FROM {lineitem} GROUP BY l_suppkey % 10, l_orderkey * 8 + l_linenumber) y"
_VERT = "SELECT CAST(t.tile AS BIGINT) AS tile, CAST(0 AS BIGINT) AS mesh, CAST(0 AS BIGINT) AS prim, CAST(v.vertex AS BIGINT) AS vertex, CAST(v.vertex * 7 % 19 AS DOUBLE) AS x, CAST(v.vertex * 5 % 23 AS DOUBLE) AS y, CAST(t.tile AS DOUBLE) AS z FROM (SELECT DISTINCT s_suppkey % 10 AS tile FROM {supplier}) t CROSS JOIN (SELECT DISTINCT p_partkey % 55 AS vertex FROM {part}) v"
_IDS = "SELECT tile, mesh, prim, vertex, CAST(vertex % 6 AS DOUBLE) + 0.4E0 AS feature FROM ({vertices}) WHERE vertex % 8 <> 7 AND tile <> 3"


@_query(f"SELECT f.tile, triangle, feature, coalesce(nullif(CASE WHEN feature % 3 = 0 THEN '' WHEN feature % 3 = 1 THEN concat('o', feature) END, ''), 'anchor') AS owner FROM (SELECT t.tile, triangle, coalesce(CAST(floor(i.feature + 0.5) AS BIGINT), 0) AS feature FROM ({T.duck(_TRI)}) t LEFT JOIN ({_IDS.replace('{vertices}', T.duck(_VERT))}) i ON i.tile = t.tile AND i.vertex = t.v0 WHERE t.tile <> 3) f")
def q_feature_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = T.derived(spark, sf_dir, _IDS.replace("{vertices}", _VERT))
    features = geometry.feature_of_triangles(T.derived(spark, sf_dir, _TRI), ids)
    paths = ids.selectExpr("tile", "cast(floor(feature + 0.5) AS bigint) AS feature").distinct().withColumn("node_path", F.expr("concat('n', feature)"))
    owner = paths.select("node_path", "feature").distinct().selectExpr("node_path", "CASE WHEN feature % 3 = 0 THEN '' WHEN feature % 3 = 1 THEN concat('o', feature) END AS owner").where("owner is not null")
    return geometry.owners(features.select("tile", "triangle", "feature"), paths, owner, "anchor").select("tile", "triangle", "feature", "owner")


@_query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY triangle) - 1 AS place FROM ({T.duck(_TRI)}) WHERE triangle % 3 = 0),
c AS (SELECT tile, place * 3 + k AS slot, CASE k WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END AS vertex FROM t, range(3) r(k)), e AS (SELECT c.* FROM c SEMI JOIN ({T.duck(_VERT)}) v ON v.tile = c.tile AND v.vertex = c.vertex),
f AS (SELECT tile, vertex, row_number() OVER (PARTITION BY tile ORDER BY min(slot)) - 1 AS local FROM e GROUP BY tile, vertex) SELECT e.tile, e.slot, e.vertex, f.local FROM e JOIN f USING (tile, vertex)""")
def q_submesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    triangles = T.derived(spark, sf_dir, _TRI)
    chosen = triangles.where("triangle % 3 = 0").withColumn("place", (F.row_number().over(Window.partitionBy("tile").orderBy("triangle")) - 1).cast("bigint")).select("tile", "mesh", "prim", "triangle", "place")
    return geometry.submesh(triangles, T.derived(spark, sf_dir, _VERT), chosen).select("tile", "slot", "vertex", "local")


@_query(f"SELECT tile, vertex, x, y, z FROM ({T.duck(_VERT)})")
def q_glb_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices packed into binary glTF, a file for each tile, and decoded again."""
    import json

    from quadrille.sources import glb

    def pack(frame):
        points = frame.sort_values("vertex")[["x", "y", "z"]].to_numpy("<f4")
        doc = {"asset": {"version": "2.0"}, "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "buffers": [{"byteLength": points.nbytes}],
               "bufferViews": [{"buffer": 0, "byteLength": points.nbytes}], "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(points), "type": "VEC3"}]}
        return frame[["tile"]].head(1).assign(content=[glb.assemble(json.dumps(doc).encode(), points.tobytes())])

    packed = T.derived(spark, sf_dir, _VERT).select("tile", "vertex", "x", "y", "z").groupBy("tile").applyInPandas(pack, "tile bigint, content binary")
    return glb.tables(glb.decode_tiles(packed, "tile"), "tile")["vertices"].select("tile", "vertex", "x", "y", "z")


@_query(f"SELECT tile, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM ({T.duck(_VERT)}) GROUP BY tile")
def q_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.bounds(T.derived(spark, sf_dir, _VERT), "tile")


@_query("SELECT p_partkey, (p_size * 12 + CASE WHEN p_size % 2 = 0 THEN p_size * 12 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN p_size * 2 ELSE 0 END)::BIGINT AS bytes FROM part")
def q_resident_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.derived(spark, sf_dir, "SELECT p_partkey, p_size FROM {part}").selectExpr("p_partkey", "array_repeat(array(0F, 0F, 0F), p_size) AS positions", "if(p_size % 2 = 0, array_repeat(array(0F, 0F, 1F), p_size), null) AS normals", "cast(null AS array<array<float>>) AS uvs", "cast(null AS array<array<float>>) AS colors", "if(p_size % 3 = 0, array_repeat(0, p_size), null) AS indices")
    return geometry.resident_cost(rows).select("p_partkey", "bytes")


@_query("SELECT set_id, tile, least(8, CASE WHEN b = 0 OR s <= b THEN 1 ELSE least(8, s::DOUBLE / b) END)::DOUBLE AS pressure FROM (SELECT l_suppkey % 8 AS set_id, l_orderkey * 8 + l_linenumber AS tile, CAST(l_quantity AS BIGINT) AS s, (l_partkey % 9)::BIGINT AS b FROM lineitem)")
def q_pressure_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.derived(spark, sf_dir, "SELECT l_suppkey % 8 AS set_id, l_orderkey * 8 + l_linenumber AS tile, CAST(l_quantity AS BIGINT) AS s, CAST(l_partkey % 9 AS BIGINT) AS b FROM {lineitem}").selectExpr("set_id", "tile", f"{D.pressure('s', 'b')} AS pressure")
