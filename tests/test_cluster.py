"""Metadata changes, replication events, inhibition, retries and collectors by hand."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from streamloom.operators import alerts as AL
from streamloom.operators import collectors as CO
from streamloom.operators import limits as LI
from streamloom.operators import replication as R
from streamloom.operators.cluster import Cluster
from streamloom.operators.windows import WindowConfig
from streamloom.plans.topology import StreamBuilder
from streamloom.streaming.runtime import Application, RetryPolicy

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_metadata(spark):
    now = [T0]
    c = Cluster(default_replication=2, clock=lambda: now[0])
    with pytest.raises(ValueError, match="0 brokers online"):
        c.create_topic("t", 1)
    for b in "ab":
        c.register_broker(b, "h", 1)
    assert c.create_topic("t", 3).replication_factor == 2
    for bad in (("t", 1, 1), ("u", 0, 1), ("u", 1, -1), ("u", 1, 3)):
        with pytest.raises(ValueError):
            c.create_topic(*bad)
    assert sorted(r.broker_id for r in c.placement(spark).where("is_leader").collect()) == ["a", "a", "b"]
    now[0] += timedelta(minutes=1)
    c.heartbeat("a")
    assert c.expire_brokers(timedelta(seconds=30)) == ["b"] and c.broker("b").status == "offline"
    with pytest.raises(ValueError, match="1 brokers online"):
        c.create_topic("u", 1, 2)
    c.heartbeat("b")
    c.unregister_broker("b")
    c.delete_topic("t")
    for missing in (lambda: c.broker("b"), lambda: c.heartbeat("b"), lambda: c.topic("t"), lambda: c.delete_topic("t"), lambda: c.unregister_broker("x")):
        with pytest.raises(KeyError):
            missing()
    assert c.topics(spark).count() == 0 and c.brokers(spark).count() == 1
    assert [r.type for r in c.events(spark).collect()] == ["broker_registered"] * 2 + ["topic_created", "broker_offline", "broker_unregistered", "topic_deleted"]


def test_collectors(spark):
    df = CO.readings(spark, {"a": 1, "b": 2.5, "c": timedelta(milliseconds=1500), "d": "leader", "e": {"0": 3, "1": 4.0}, "f": True, "g": None})

    def got(name):
        return {(r.name, *sorted(r.labels.items())): r.value for r in CO.collect(df, name).collect()}

    assert got("storage") == {("storage_a",): 1.0, ("storage_b",): 2.5}
    assert got("raft") == {("raft_a",): 1.0, ("raft_b",): 2.5, ("raft_c_seconds",): 1.5, ("raft_d_info", ("state", "leader")): 1.0}
    assert got("consumer_group") == {("consumer_group_a",): 1.0, ("consumer_group_b",): 2.5, ("consumer_group_e", ("partition", "0")): 3.0, ("consumer_group_e", ("partition", "1")): 4.0}
    last = CO.readings(spark, CO.progress({"batchId": 3, "numInputRows": 10, "durationMs": {"commit": 20}, "stateOperators": [{"numRowsTotal": 5}]}))
    assert {r.name: r.value for r in CO.collect(last, "stream").collect()} == {"stream_batchId": 3.0, "stream_numInputRows": 10.0, "stream_commit_duration_seconds": 0.02, "stream_state_rows": 5.0}


def test_inhibited(spark):
    made = [(1, "Down", "critical", "firing", {"dc": "x"}), (2, "Slow", "warning", "firing", {"dc": "x"}), (3, "Slow", "warning", "firing", {"dc": "y"}), (4, "Slow", "warning", "firing", {}), (5, "Down", "critical", "inactive", {}), (6, "Slow", "warning", "firing", None)]
    df = spark.createDataFrame(made, "id int, rule string, severity string, status string, alert_labels map<string,string>")

    def left(*args):
        return sorted(r.id for r in AL.inhibit(df, *args).collect())

    assert left({"severity": "critical"}, {"severity": "warning"}, ["dc"]) == [1, 3, 4, 5, 6]
    assert left({"alertname": "Down"}, {"alertname": "Slow"}, []) == [1, 5]
    assert left({"alertname": "Other"}, {}, []) == [1, 2, 3, 4, 5, 6]


def test_replicas_that_fall_behind_and_catch_up(spark):
    kind = "topic string, partition int, replica string, log_end_offset long, last_fetch_offset long, last_fetch_time timestamp, last_heartbeat timestamp"
    before = spark.createDataFrame([("t", 0, "a", 5000, 5000, T0, T0), ("t", 0, "b", 5000, 100, T0, T0), ("t", 0, "c", 5000, 5000, T0, T0)], kind)
    after = spark.createDataFrame([("t", 0, "a", 9000, 5000, T0, T0), ("t", 0, "b", 9000, 8500, T0, T0), ("t", 0, "c", 9000, 9000, T0, T0)], kind)
    got = sorted((r.type, r.data) for r in R.replica_events(before, after, F.lit(T0)).collect())
    assert got == [("replica_caught_up", '{"replica":"b"}'), ("replica_lag", '{"replica":"a","lag_messages":4000}')]


def test_adaptive_rates_begin_anew_with_each_key(spark):
    df = spark.createDataFrame([("a", i, 100, 50) for i in range(3)] + [("b", i, 100, 0) for i in range(3)] + [(None, 0, 0, 0)], "k string, i int, requests long, errors long")
    got = {(r.k, r.i): r.rate for r in LI.adaptive_rates(df, ["k"], ["i"], 100, 0.2, 60, 130).collect()}
    assert got == {("a", 0): 80, ("a", 1): 64, ("a", 2): 60, ("b", 0): 120, ("b", 1): 130, ("b", 2): 130, (None, 0): 120}


def test_waits_grow_to_a_limit():
    assert [d.total_seconds() for d in RetryPolicy(retries=8).delays()] == [0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 5.0, 5.0]


def test_a_failed_query_starts_again(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    gate, seen = tmp_path / "gate", []

    def check(batches):
        import os

        if not os.path.exists(str(gate)):
            raise RuntimeError("not yet")
        yield from batches

    df = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").mapInPandas(check, "id long")
    app = Application(spark, "again", RetryPolicy(retries=2, delay=timedelta(milliseconds=1)))
    app.on_error = lambda topic, e: (seen.append(topic), gate.write_text(""))
    app.set_topology({"out": df}).start(root=f"{tmp_path}/run")
    app.wait()
    assert seen == ["out"] and spark.read.parquet(f"{tmp_path}/run/out/data").count() == 20


def test_event_time_from_the_configuration(spark):
    df = spark.createDataFrame([("a", 60_000_000)], "key string, us long")
    b = StreamBuilder(config=WindowConfig(timestamp=F.timestamp_micros("us")))
    out = b.source(data=df).window(timedelta(minutes=1)).count().df.select(F.unix_seconds("window_start")).first()
    assert out[0] == 60


def test_creation_time_of_the_header(spark):
    kind = "struct<key:string,value:string,ts:timestamp,headers:map<string,string>,offset:long>"
    made = [(("k", "a", T0, {"creation_time": "2024-01-02T00:00:00Z"}, 1), ("k", "b", T0 + timedelta(hours=1), {"creation_time": "2023-01-01T00:00:00Z"}, 2)), (("k", "a", T0, {"creation_time": "no time"}, 1), ("k", "b", T0 + timedelta(hours=1), {}, 2))]
    df = spark.createDataFrame(made, f"local {kind}, remote {kind}")
    assert [r.side for r in R.resolve(df, "creation_time").collect()] == ["local", "remote"]
