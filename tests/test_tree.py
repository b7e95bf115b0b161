"""Tileset documents, flattening, grafting, archives through Spark, and the streams."""

import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.sources import archive, tileset
from quadrille.operators import tree
from quadrille.plans import catalogue

SF = "/root/testdata/sf0.001"
DOC = {
    "asset": {"version": "1.1"}, "geometricError": 16, "extra": 1,
    "root": {"boundingVolume": {"sphere": [0, 0, 0, 30]}, "geometricError": 16, "refine": "ADD", "transform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 100, 0, 0, 1],
             "children": [{"geometricError": 4, "boundingVolume": {"box": [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]}, "transform": [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 3, 1], "content": {"uri": "a/b.glb"}},
                          {"geometricError": 0, "boundingVolume": {"region": [0, 0, 0.1, 0.1, 0, 1]}, "refine": "REPLACE", "content": {"url": "sub/tileset.json"}}]},
}


def docs(spark, *texts, **columns):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "set_id bigint, text string")
    return tileset.parse(rows).withColumns({c: F.lit(v) for c, v in columns.items()})


def test_parse_errors(spark):
    rows = docs(spark, json.dumps(DOC), "{", '{"root": {}}').orderBy("set_id").collect()
    assert [r.error for r in rows] == [None, "not JSON", "no geometricError"]


def test_build(spark):
    rows = tree.build(docs(spark, json.dumps(DOC), frame="local")).orderBy("tile").collect()
    assert [(r.tile, r.parent, r.depth, r.refine, r.content_uri) for r in rows] == [(0, None, 0, "ADD", None), (1, 0, 1, "ADD", "a/b.glb"), (2, 0, 1, "REPLACE", "sub/tileset.json")]
    assert rows[0].volume.center == [100, 0, 0] and rows[1].volume.center == [100, 0, 3] and rows[1].volume.half_axes[0] == 2
    assert rows[2].volume == rows[0].volume  # a region in a local tree inherits


def test_root_without_volume(spark):
    bad = json.loads(json.dumps(DOC))
    bad["root"]["boundingVolume"] = {"region": [0, 0, 0.1, 0.1, 0, 1]}
    with pytest.raises(Exception, match="no usable bounding volume"):
        tree.build(docs(spark, json.dumps(bad), frame="local")).collect()
    assert tree.build(docs(spark, json.dumps(bad), frame="ecef")).where("depth = 0").first().volume.kind == "obb"


def test_graft(spark):
    nodes = tree.build(docs(spark, json.dumps(DOC), frame="local"))
    external = {"asset": {"version": "1.1"}, "geometricError": 1, "root": {"geometricError": 1, "boundingVolume": {"sphere": [1, 0, 0, 2]}, "children": [{"geometricError": 0, "boundingVolume": {"sphere": [0, 0, 0, 1]}, "content": {"uri": "c.glb"}}]}}
    out = tree.graft(nodes, docs(spark, json.dumps(external), frame="local").withColumn("at", F.lit(2).cast("bigint"))).orderBy("tile").collect()
    assert [(r.tile, r.parent, r.content_uri, r.refine) for r in out] == [(0, None, None, "ADD"), (1, 0, "a/b.glb", "ADD"), (2, 0, None, "REPLACE"), (3, 2, None, "REPLACE"), (4, 3, "sub/c.glb", "REPLACE")]
    assert out[3].volume.center == [101, 0, 0]


def test_graft_looks_for_no_host_by_path(spark, monkeypatch):
    from quadrille import tables

    plans = []
    keep = lambda df, *partitions: (plans.append(df._jdf.queryExecution().executedPlan().toString()), written(df, *partitions))[1]
    written = tables.written
    monkeypatch.setattr(tables, "written", keep)
    monkeypatch.setattr(tree, "written", keep)
    nodes = tree.build(docs(spark, json.dumps(DOC), frame="local"))
    plans.clear()
    external = {"asset": {"version": "1.1"}, "geometricError": 1, "root": {"geometricError": 1, "boundingVolume": {"sphere": [1, 0, 0, 2]}, "children": [{"geometricError": 0, "content": {"uri": u}} for u in ("c.glb", "/d.glb")]}}
    at = spark.range(3).selectExpr("0L AS set_id", "id AS at").join(docs(spark, json.dumps(external), frame="local"), "set_id")
    out = tree.graft(nodes, at).orderBy("tile").collect()
    # Tiles of all hosts of a set would be compared with all of its hosts: the square of their number.
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "slice(" in line]
    assert any("REBALANCE" in plan for plan in plans)  # one node's children are dealt over tasks
    # By path: the root's graft is its last child, after what hangs below its first and second.
    assert [(r.tile, r.parent, r.depth, r.content_uri) for r in out] == [
        (0, None, 0, None), (1, 0, 1, None), (2, 0, 1, None), (3, 1, 2, None), (4, 3, 3, "a/c.glb"), (5, 3, 3, "/d.glb"),
        (6, 2, 2, None), (7, 6, 3, "sub/c.glb"), (8, 6, 3, "/d.glb"), (9, 0, 1, None), (10, 9, 2, "c.glb"), (11, 9, 2, "/d.glb"),
    ]


def test_transforms_are_read_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(tree, "written", lambda df, *partitions: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), df)[1])
    tree.flatten(docs(spark, json.dumps(DOC), frame="local"))
    assert plans[0].count("$.transform") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["q_graft", "q_tree_flatten"])
def test_nations_without_customers(spark, tmp_path, name):
    con = duckdb.connect()
    for table, some in (("region", "true"), ("nation", "true"), ("customer", "c_nationkey IN (3, 8, 15)")):
        con.execute(f"COPY (SELECT * FROM read_parquet('{SF}/{table}.parquet') WHERE {some}) TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_frames(spark):
    assert tileset.framed(docs(spark, json.dumps(DOC)).withColumn("live", F.lit(False))).first().frame == "local"
    assert tileset.framed(docs(spark, json.dumps(DOC)).withColumn("live", F.lit(True))).first().frame == "ecef"


def test_archives_through_spark(spark):
    rows = spark.createDataFrame([("x", f"t/{i}", bytearray([i] * 9), i % 2 == 0) for i in range(20)], "archive string, path string, data binary, deflate boolean")
    packed = archive.write_archives(rows).selectExpr("archive AS path", "content")
    broken = spark.createDataFrame([("y", bytearray(50))], "path string, content binary")
    out = archive.read_archives(packed.union(broken)).toPandas()
    assert len(out) == 21 and out["error"].notna().sum() == 1
    assert {p: bytes(d) for p, d in zip(out["path"], out["data"], strict=True) if p} == {f"t/{i}": bytes([i] * 9) for i in range(20)}


def test_ranked_is_a_window(spark):
    from pyspark.sql import Window

    from quadrille.tables import ranked

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 1, if(id % 97 = 5, null, id % 11)) AS set_id", "id * 7919 % 3001 AS k", "array(cast(id % 5 AS int)) AS path")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("set_id").orderBy("path", "k")) - 1)
    got = ranked(rows.repartition(7), ["set_id"], ["path", "k"], "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and ranked(rows.where("false"), ["set_id"], ["k"], "n").count() == 0


def test_bounded_intake(spark):
    from quadrille.operators.schedule import bounded_intake

    rows = spark.createDataFrame([(k, k % 3 == 1) for k in range(12)], "seq bigint, lands boolean")
    got = lambda most: [(r.seq, r.landed_before) for r in bounded_intake(rows, most).orderBy("seq").collect()]
    assert got(2) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)] and len(got(50)) == 12 and got(50)[-1] == (11, 4) and got(0) == []


def test_slots_stream(spark, tmp_path):
    from quadrille.streaming.slots import run_slots

    names = ["set_id", "tile", "seq", "frame", "kind", "generation", "bytes"]
    events = [(1, 7, 0, 1, "request", 5, 0), (1, 7, 1, 2, "payload", 4, 10), (1, 7, 2, 3, "payload", 5, 10), (1, 7, 3, 700, "sweep", 0, 0), (1, 8, 4, 1, "request", 6, 0), (1, 8, 5, 1, "cancel", 0, 0)]
    pd.DataFrame(events, columns=names).to_parquet(tmp_path / "e.parquet")
    schema = "set_id bigint, tile bigint, seq bigint, frame bigint, kind string, generation bigint, bytes bigint"
    q = run_slots(spark.readStream.schema(schema).parquet(str(tmp_path))).writeStream.format("memory").queryName("slots_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = [r.what for r in spark.table("slots_out").orderBy("seq").collect()]
    assert got == ["started", "dropped", "landed", "evicted", "started", "cancelled"]
