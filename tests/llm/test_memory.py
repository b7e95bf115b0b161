"""What the executors hold: sizes of the batches that workers are sent, and no second kind of worker."""

import pyarrow as pa
import pytest

from quadrille.llm import common, language_id

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def plain(spark):
    before = spark.conf.get(KEY)
    spark.conf.unset(KEY)
    yield spark
    spark.conf.set(KEY, before.removesuffix("b"))


def test_workers_are_sent_small_batches(plain):
    size = 100_000
    docs = plain.range(200).coalesce(1).selectExpr("id AS doc_id", f"repeat(char(65 + id % 26), {size}) AS text")
    whole = lambda batch: pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])
    batches = common.map_rows(docs, "text", whole, "n bigint, bytes bigint", most=1 << 40).collect()
    assert sum(b.n for b in batches) == 200
    assert max(b.bytes for b in batches) <= common.BATCH_BYTES + 2 * size


def test_a_smaller_setting_of_the_session_stays(plain):
    plain.conf.set(KEY, "1000000")
    common.small_batches(plain)
    assert plain.conf.get(KEY).removesuffix("b") == "1000000"


def python_rdds(df):
    return "PythonRDD" in df._jdf.queryExecution().toRdd().toDebugString()


def test_rows_of_the_driver_start_no_workers(spark):
    right = spark.createDataFrame([(1, None, 5000, [1, 2]), (2, "b", 4000, None), (3, "c", 1, [])], "k bigint, s string, c bigint, l array<bigint>")
    rows = right.collect()
    got = common.local_rows(spark, rows, right.schema)
    assert got.schema == right.schema and got.collect() == rows and not python_rdds(got)
    assert common.local_rows(spark, [], right.schema).collect() == []


def test_no_operator_sends_the_drivers_rows_through_workers(spark, monkeypatch):
    made, create = [], type(spark).createDataFrame

    def seen(self, *args, **kwargs):
        made.append(create(self, *args, **kwargs))
        return made[-1]

    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of ', id, repeat(' and more', 40)) AS text", "if(id % 2 = 0, 'aa', 'bb') AS lang").localCheckpoint()
    right = spark.range(3).selectExpr("id AS k", "cast(5000 as bigint) AS c").localCheckpoint()
    monkeypatch.setattr(type(spark), "createDataFrame", seen)
    assert set(language_id.learn(docs)) == {"aa", "bb"}
    assert common.keyed_join(spark.range(30).selectExpr("id % 5 AS k"), right, ["k"], "c", ready=True).count() == 18
    assert len(made) == 2 and not any(map(python_rdds, made))
