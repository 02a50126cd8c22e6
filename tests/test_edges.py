"""Hand-written rows for cases the tables do not hold."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from streamloom.functions import scalar as S
from streamloom.operators import aggregates as A
from streamloom.operators import alerts as AL
from streamloom.operators import exporters as X
from streamloom.operators import groups as G
from streamloom.operators import joins as J
from streamloom.operators import limits as LI
from streamloom.operators import log as L
from streamloom.operators import metrics as M
from streamloom.operators import replication as R
from streamloom.operators.windows import Global, Session, Sliding, Tumbling, WindowRegistry
from streamloom.plans.topology import StreamBuilder

MIN = timedelta(minutes=1)


def at(text):
    return datetime.fromisoformat(f"2024-01-01 {text}")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sliding_boundary(spark):
    df = spark.createDataFrame([("a", at("00:05:00")), ("a", at("00:10:00"))], "k string, ts timestamp")
    got = rows(A.windowed(df, Sliding(10 * MIN, 5 * MIN), ["k"], "ts", n=F.count("*")).select("window_start", "n"))
    assert got == [(at("00:00"), 1), (at("00:05"), 2), (at("00:10"), 1)]


def test_session_gap_is_inclusive_and_bridges_late_rows(spark):
    df = spark.createDataFrame([("a", at("00:00:00")), ("a", at("00:05:00")), ("a", at("00:10:01")), ("b", at("00:00:00")), ("b", at("00:08:00")), ("b", at("00:04:00"))], "k string, ts timestamp")
    got = rows(A.windowed(df, Session(5 * MIN), ["k"], "ts", n=F.count("*")).select("k", "window_start", "window_end", "n"))
    assert got == [("a", at("00:00"), at("00:05"), 2), ("a", at("00:10:01"), at("00:10:01"), 1), ("b", at("00:00"), at("00:08"), 3)]


def test_weekly_windows_start_on_monday(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 3))], "k string, ts timestamp")
    assert A.windowed(df, Tumbling(timedelta(days=7)), ["k"], "ts", n=F.count("*")).first().window_start == datetime(2024, 1, 1)


@pytest.mark.parametrize("how, expected", [("inner", [(1, 1)]), ("left", [(1, 1), (2, None)]), ("right", [(1, 1), (None, 2)]), ("full", [(1, 1), (2, None), (None, 2)])])
def test_join_bound_is_inclusive(spark, how, expected):
    left = spark.createDataFrame([(1, "a", at("00:00:00")), (2, "b", at("00:00:00"))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([(1, "a", at("01:00:00")), (2, "a", at("01:00:01"))], "id int, k string, ts timestamp")
    got = J.interval_join(left, right, "k", "k", timedelta(hours=1), how).select(F.col("l.id").alias("x"), F.col("r.id").alias("y")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_count_trigger(spark):
    df = spark.createDataFrame([(i, "a", at(f"00:00:0{i}")) for i in range(3)], "id int, k string, ts timestamp")
    out = StreamBuilder().source(data=df, key="k").window(MIN).trigger_count(2).df
    assert [(r.id, r.running_count) for r in out.orderBy("id").collect()] == [(1, 2), (2, 3)]


def test_compaction_keeps_offsets_and_obeys_tombstones(spark):
    log = spark.createDataFrame([(0, "k1", "v1"), (1, "k2", "v2"), (2, "k1", "v3"), (3, "k2", None)], "offset long, key string, value string")
    assert rows(L.compact(log, ["key"], ["offset"], F.col("value").isNull())) == [(2, "k1", "v3")]


def test_partitioner(spark):
    df = spark.createDataFrame([("user-1",), ("",), (None,)], "k string")
    assert [r[0] for r in df.select(S.choose_partition(F.col("k"), 8)).collect()] == [4, 0, 0]


def test_split_words(spark):
    df = spark.createDataFrame([("a  b\tc\nA ",), ("x\ry",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(S.split_words(F.col("t"))).collect()] == [["a", "b", "c", "A"], ["x\ry"], [], None]


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (9.0,)], "v double")
    got = {r.le: (r.bucket_count, r.total_sum) for r in M.histogram(df, [], "v", (1.0, 2.5)).collect()}
    assert got == {1.0: (2, 12.5), 2.5: (3, 12.5), float("inf"): (4, 12.5)}


def test_percentiles_take_elements(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 11)], "k string, ts int, v double")
    assert {r.p: r.v for r in M.timer_percentiles(df, ["k"], "v", ["ts"]).collect()} == {0.5: 6.0, 0.9: 10.0, 0.95: 10.0, 0.99: 10.0}


def test_percentiles_use_the_last_samples(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "k string, ts int, v double")
    assert {r.p: r.v for r in M.timer_percentiles(df, ["k"], "v", ["ts"], samples=10).collect()}[0.5] == 15.0


def message(value="v", key="k", ts="00:00:00", offset=1, **headers):
    return (key, value, at(ts), headers, offset)


@pytest.fixture(scope="module")
def pair(spark):
    kind = "struct<key:string,value:string,ts:timestamp,headers:map<string,string>,offset:long>"

    def make(local, remote):
        return spark.createDataFrame([(local, remote)], f"local {kind}, remote {kind}")

    return make


def test_conflict_types_by_priority(pair):
    kinds = [(message(), message("w", "x")), (message(), message(key="x", ts="00:00:01")), (message(), message(ts="00:00:01", a="1")), (message(), message(a="1")), (message(), message()), (message(), None)]
    assert [pair(a, b).select(R.conflict_type()).first()[0] for a, b in kinds] == ["value", "key", "timestamp", "header", None, None]


def test_conflict_ties(pair):
    def side(strategy, a, b):
        return tuple(pair(a, b).select(R.winner(strategy).alias("w")).first().w)

    assert side("last_write", message(), message("w")) == ("local", 0.8)
    assert side("last_write", message(), message("w", offset=2)) == ("remote", 0.8)
    assert side("first_write", message(), message("w")) == ("remote", 0.8)
    assert side("priority", message(priority="high"), message("w", priority="high")) == ("remote", 0.95)
    assert side("priority", message(priority="high"), message("w", priority="low")) == ("local", 0.95)
    assert side("priority", message(priority="high"), message("w", offset=2)) == ("remote", 0.8)
    assert side("creation_time", message(creation_time="2024-01-02T00:00:00Z"), message("w", ts="05:00:00")) == ("local", 0.9)
    assert side("vector_clock", message(vc_a="1"), message("w", vc_a="1", vc_b="1"))[0] == "remote"
    assert side("vector_clock", message(vc_a="1"), message("w", vc_a="1")) == (None, None)


def test_vector_clocks(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"a": 2, "b": 1}), ({"a": 1}, {"a": 1, "b": 1}), ({}, {}), ({"a": 2}, {"a": 1})], "x map<string,long>, y map<string,long>")
    assert [r[0] for r in df.select(S.compare_clocks(F.col("x"), F.col("y"))).collect()] == ["concurrent", "before", "equal", "after"]


@pytest.fixture(scope="module")
def two_members(spark):
    return spark.createDataFrame([("g", "m1", ["t"]), ("g", "m2", ["t"])], "group_id string, member_id string, subscription array<string>"), spark.createDataFrame([("t", 5, 2)], "topic string, partitions int, replication_factor int")


def test_range_and_round_robin(two_members):
    m, t = two_members
    assert rows(G.range_assignment(m, t).select("member_id", "partition")) == [("m1", 0), ("m1", 1), ("m1", 2), ("m2", 3), ("m2", 4)]
    for out in (G.round_robin_uniform(m, t), G.assign(m, t, "round_robin")):
        assert rows(out.select("member_id", "partition")) == [("m1", 0), ("m1", 2), ("m1", 4), ("m2", 1), ("m2", 3)]


def test_sticky_keeps_and_validation_finds_nothing(spark, two_members):
    m, t = two_members
    before = spark.createDataFrame([("g", "m1", "t", p) for p in (0, 1)] + [("g", "gone", "t", 2)], G.ASSIGNMENT)
    out = G.assign(m, t, "sticky", before)
    got = rows(out.select("member_id", "partition"))
    assert {("m1", 0), ("m1", 1)} <= set(got) and sorted(p for _, p in got) == [0, 1, 2, 3, 4]
    assert G.validate(out, m, t).count() == 0
    assert not G.unbalanced(out, m).first().unbalanced


def test_validation(spark, two_members):
    m, t = two_members
    bad = spark.createDataFrame([("g", "m9", "t", 0), ("g", "m1", "u", 0), ("g", "m1", "t", 7), ("g", "m1", "t", 3), ("g", "m2", "t", 3)], G.ASSIGNMENT)
    assert sorted(r.problem for r in G.validate(bad, m, t).collect()) == ["duplicate", "duplicate", "unknown_member", "unknown_partition", "unknown_topic"]


def test_replica_placement(spark):
    t = spark.createDataFrame([("t", 3, 2)], "topic string, partitions int, replication_factor int")
    b = spark.createDataFrame([("b1",), ("b2",), ("b3",)], "broker_id string")
    got = sorted((r.partition, r.replica, r.broker_id, r.is_leader) for r in G.replica_placement(t, b).collect())
    assert got == [(0, 0, "b1", True), (0, 1, "b2", False), (1, 0, "b2", True), (1, 1, "b3", False), (2, 0, "b3", True), (2, 1, "b1", False)]


def test_isr_and_high_watermark(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("t", 0, i, f"r{i}", "r0", 5000, f, at("00:00:00"), at("00:00:00")) for i, f in enumerate((4500, 3000))], "topic string, partition int, replica_index int, replica string, leader string, log_end_offset long, last_fetch_offset long, last_fetch_time timestamp, last_heartbeat timestamp")
    assert R.isr(df, now, "r0").first().isr == ["r0"]
    assert R.high_watermark(df, now).first().high_watermark == 4500
    assert R.isr(df, now, "r1").count() == 0


def test_alert_episode(spark):
    df = spark.createDataFrame([("r", at(f"00:0{i}:00"), v > 10, 120_000_000) for i, v in enumerate((12, 13, 11, 5, 20))], "rule string, ts timestamp, holds boolean, hold_us long")
    got = sorted(tuple(r) for r in AL.episodes(df, ["rule"]).select("starts_at", "fired_at", "ends_at", "status").collect())
    assert got == [(at("00:00"), at("00:02"), at("00:03"), "inactive"), (at("00:04"), None, None, "pending")]


def test_alert_still_firing(spark):
    df = spark.createDataFrame([("r", at(f"00:0{i}:00"), True, 120_000_000) for i in range(4)], "rule string, ts timestamp, holds boolean, hold_us long")
    assert [tuple(r) for r in AL.episodes(df, ["rule"]).select("starts_at", "fired_at", "last_true_at", "ends_at", "status").collect()] == [(at("00:00"), at("00:02"), at("00:03"), None, "firing")]


def test_health_rollup(spark):
    df = spark.createDataFrame([("healthy",), ("degraded",), ("unknown",)], "status string")
    assert M.overall_health(df).first().overall == "degraded"
    assert M.overall_health(df.limit(0)).first().overall == "healthy"


def test_conditions(spark):
    df = spark.createDataFrame([(1.0, c, 1.0 + 1e-10) for c in ("gt", "lt", "eq", "ne", "ge", "le", "present", "absent")] + [(None, "absent", 0.0), (float("nan"), "gt", 0.0)], "v double, c string, t double")
    assert [r[0] for r in df.select(S.condition_holds(F.col("v"), F.col("c"), F.col("t"))).collect()] == [False, True, True, False, False, True, True, False, True, False]


def test_label_texts(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({},), (None,)], "l map<string,string>")
    assert [r[0] for r in df.select(S.format_labels(F.col("l"))).collect()] == ['{a="1",b="2"}', "", ""]
    assert df.select(S.add_label(S.format_labels(F.col("l")), "le", F.lit("1"))).collect()[0][0] == '{a="1",b="2",le="1"}'
    assert df.select(S.alert_id(F.lit("r"), F.col("l"))).first()[0] == "r:a=1,b=2,"


def test_timer_exposition(spark):
    df = spark.createDataFrame([("a.b", {"x": "1"}, 3, 1.5, {0.5: 0.2})], "name string, labels map<string,string>, count long, total_seconds double, quantiles map<double,double>")
    text = X.exposition(X.timer_lines(df)).first().text
    assert "# TYPE a_b summary" in text and 'a_b{x="1",quantile="0.500000"} 0.200000' in text and 'a_b_count{x="1"} 3' in text


def test_read_gives_one_row_at_least(spark):
    log = spark.createDataFrame([("t", 0, i, "k", "v" * 100) for i in range(5)], "topic string, partition int, offset long, key string, value string")
    assert [r.offset for r in L.read(log, 2, 10).collect()] == [2]
    assert sorted(r.offset for r in L.read(log, 1, 250).collect()) == [1, 2]
    assert sorted(r.offset for r in L.read(log, 1, None, 3).collect()) == [1, 2]


def test_snapshots(spark, tmp_path):
    snapshots = L.Snapshots(spark, f"file://{tmp_path}/snapshots")
    log = spark.range(10)
    snapshots.create("a", log)
    with pytest.raises(ValueError):
        snapshots.create("a", log)
    snapshots.create("b", log)
    assert snapshots.restore("a").count() == 10 and snapshots.stats().first().n == 2
    newest = max(snapshots.list().collect(), key=lambda r: (r.created_ms, r.name))
    assert len(snapshots.cleanup(newest.created_ms, 10**9, 1)) == 1 and snapshots.list().count() == 1


def test_windows_registry(spark):
    w = WindowRegistry()
    w.create("five", Tumbling(5 * MIN))
    with pytest.raises(ValueError):
        w.create("five", Global())
    df = spark.createDataFrame([(at("00:07:00"),)], "ts timestamp")
    assert w.assign(df, "five").first().window.start == at("00:05:00")


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, value double, id long")
    assert A.windowed(df, Session(MIN), ["k"], "ts", n=F.count("*")).count() == 0
    assert J.interval_join(df, df, "k", "k", MIN, "full").count() == 0
    assert LI.token_bucket(df, "k", "ts", 1, MIN).count() == 0
    assert StreamBuilder.merge() is None


def test_adaptive_rate(spark):
    df = spark.createDataFrame([(100, 100, 30), (100, 100, 15), (100, 100, 0), (100, 0, 0)], "rate long, q long, e long")
    assert [r[0] for r in df.select(LI.adapt(F.col("rate"), F.col("q"), F.col("e"), 0.2, 90, 110)).collect()] == [90, 100, 110, 110]


def test_surplus_of_a_whole_table_without_a_one_task_window(spark):
    made = [(f"s{i:04d}", 10_000 - i // 2) for i in range(1000)] + [("none", None)]
    df = spark.createDataFrame(made, "name string, created_ms long").repartition(7)
    out = L.surplus(df, 10_000, 100, 5)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.name for r in out.collect()) == ["none", *(f"s{i:04d}" for i in range(5, 1000))]
    assert sorted(r.name for r in L.surplus(df, 10_000, 100, 500).collect()) == ["none", *(f"s{i:04d}" for i in range(202, 1000))]
    assert L.surplus(df, 10_000, 100, 2000).where("name = 'none'").count() == 0


def test_every_order_is_ranked(spark):
    from streamloom import catalog

    d = "/root/testdata/sf0.001"
    orders = catalog.io.table(spark, d, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms")).collect()
    ranked = sorted(orders, key=lambda r: (-r.ms, r.o_orderkey))
    want = {r.o_orderkey for i, r in enumerate(ranked) if r.ms < 820454400000 or i >= 10}
    got = [r.name for r in catalog.QUERIES["snapshot_surplus"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and max(got) >= 200


def test_every_event_has_its_clocks_compared(spark):
    from streamloom import catalog

    d = "/root/testdata/sf0.001"
    got = {r.event_id: r.ordering for r in catalog.QUERIES["vector_clock_cmp"](spark, d).collect()}
    ids = [r.event_id for r in catalog.io.events(spark, d).select("event_id").collect()]
    assert sorted(got) == sorted(ids)
    empty = [got[i] for i in ids if i % 5 == 4]
    assert empty and set(empty) == {"equal"}


def test_read_of_a_log_with_gaps(spark):
    log = spark.createDataFrame([("t", p, i, "k", "v" * 100) for p, i in ((0, 20), (0, 5000), (1, 7000), (1, 9000), (2, 3))], "topic string, partition int, offset long, key string, value string")
    assert rows(L.read(log, 20, 1000).select("partition", "offset")) == [(0, 20), (0, 5000), (1, 7000), (1, 9000)]
    assert rows(L.read(log, 20, 10).select("partition", "offset")) == [(0, 20), (1, 7000)]
    assert "WindowGroupLimit" in L.read(log, 20, 1000)._jdf.queryExecution().optimizedPlan().toString()


def test_sticky_query_runs_the_sticky_policy(spark, monkeypatch):
    from streamloom import catalog

    calls, assign = [], G.assign
    monkeypatch.setattr(G, "assign", lambda *a: calls.append((a, assign(*a))) or calls[-1][1])
    catalog.QUERIES["sticky_assignment"](spark, "/root/testdata/sf0.001")
    ((m, t, policy, before), out), = calls
    assert policy == "sticky"
    keys = ["group_id", "member_id", "topic", "partition"]
    assert before.count() and before.select(*keys).exceptAll(out.select(*keys)).count() == 0
    assert out.select("group_id", "topic", "partition").distinct().count() == out.count() == 11 * m.select("group_id").distinct().count()
