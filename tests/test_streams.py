"""Structured Streaming: late rows, triggers and stateful processors; batch and stream agree."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamloom.plans.topology import StreamBuilder
from streamloom.streaming import runtime as RT

MIN = timedelta(minutes=1)


def at(minute, second=0):
    return datetime(2024, 1, 1, minute // 60, minute % 60, second)


def stream(spark, path, batches, schema):
    """A file stream of one file a batch, read one at a time."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{path}/batch={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_late_row_is_dropped_in_append_mode(spark, tmp_path):
    # A batch drops what lies before the watermark its predecessor began with, so the late row comes two batches on.
    rows = [[("a", at(0, 1))], [("a", at(10))], [("a", at(15))], [("a", at(0, 2)), ("a", at(20))], [("a", at(40))]]
    df = stream(spark, tmp_path / "in", rows, "k string, ts timestamp")
    s = StreamBuilder().source(data=df, key="k").watermark(timedelta(seconds=10)).window(MIN).count()
    got = {r.window_start: r["count"] for r in RT.drain(s.df).collect()}
    assert got == {at(0): 1, at(10): 1, at(15): 1, at(20): 1}
    batch = StreamBuilder().source(data=spark.read.schema("k string, ts timestamp").parquet(str(tmp_path / "in/*")), key="k").window(MIN).count()
    assert {r.window_start: r["count"] for r in batch.df.collect()} == {at(0): 2, at(10): 1, at(15): 1, at(20): 1, at(40): 1}


def test_application_lifecycle(spark, tmp_path):
    df = stream(spark, tmp_path / "in", [[("a", at(0))]], "k string, ts timestamp")
    app = RT.Application(spark, "app")
    with pytest.raises(ValueError):
        app.set_topology({})
    app.set_topology({"out": df})
    app.start(root=f"file://{tmp_path}/app")
    app.wait()
    assert not app.is_running() and "out" in app.metrics()
    assert spark.read.schema("k string, ts timestamp").parquet(f"file://{tmp_path}/app/out/data").count() == 1
    catalog = RT.StreamCatalog()
    catalog.create("x", app)
    with pytest.raises(ValueError):
        catalog.create("x", app)
    assert catalog.list() == ["x"]
    catalog.delete("x")
    assert catalog.list() == []


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", RT.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_count_trigger_processor(spark, tmp_path, rocksdb):
    df = stream(spark, tmp_path / "in", [[("a", 1.0), ("b", 5.0)], [("a", 2.0), ("a", 4.0)]], "k string, value double")
    s = StreamBuilder().source(data=df, key="k").process(RT.CountTriggerProcessor(2, "value"), "key string, running_count long, running_sum double")
    assert sorted((r.key, r.running_count) for r in RT.drain(s.df).collect()) == [("a", 2), ("a", 3)]


def test_token_bucket_processor(spark, tmp_path, rocksdb):
    df = stream(spark, tmp_path / "in", [[("a", at(0)), ("a", at(0, 1)), ("a", at(0, 2))], [("a", at(1))]], "k string, ts timestamp")
    s = StreamBuilder().source(data=df, key="k").process(RT.TokenBucketProcessor(2, MIN, "ts"), "key string, ts_us long, allowed boolean, tokens_left long")
    assert [r.allowed for r in RT.drain(s.df).orderBy("ts_us").collect()] == [True, True, False, True]


def test_alert_processor(spark, tmp_path, rocksdb):
    df = stream(spark, tmp_path / "in", [[("a", at(0), True), ("a", at(1), True)], [("a", at(2), True), ("a", at(3), False)], [("a", at(4), True), ("a", at(5), False)]], "k string, ts timestamp, holds boolean")
    s = StreamBuilder().source(data=df, key="k").process(RT.AlertProcessor(2 * MIN, "ts", "holds"), "key string, ts_us long, status string")
    assert [r.status for r in RT.drain(s.df).orderBy("ts_us").collect()] == ["pending", "firing", "inactive", "pending", "removed"]


def test_peek_observes(spark):
    df = spark.range(5).withColumn("ts", F.current_timestamp())
    assert StreamBuilder().source(data=df, key="id").peek("n").df.count() == 5
