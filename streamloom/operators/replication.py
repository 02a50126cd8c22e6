"""Replication state as tables, and conflicts between two versions of a record."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bytes_equal, compare_clocks, creation_time, headers_equal, micros, priority, vector_clock

LAG_MESSAGES = 1000
LAG_TIME = timedelta(seconds=30)
HEARTBEAT = timedelta(seconds=5)


def _age(now: Column, ts: str) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))


def in_sync(now: Column, lag: int = LAG_MESSAGES, lag_time: timedelta = LAG_TIME, heartbeat: timedelta = HEARTBEAT) -> Column:
    """Of a replica row (log_end_offset, last_fetch_offset, last_fetch_time, last_heartbeat)."""
    return (F.col("log_end_offset") - F.col("last_fetch_offset") <= lag) & (_age(now, "last_fetch_time") <= micros(lag_time)) & (_age(now, "last_heartbeat") <= 2 * micros(heartbeat))


def isr(replicas: DataFrame, now: Column, node: str | None = None) -> DataFrame:
    """(topic, partition, isr) in replica order; with `node` only of partitions it leads."""
    rows = replicas if node is None else replicas.where(F.col("leader") == node)
    kept = F.sort_array(F.collect_list(F.when(in_sync(now), F.struct("replica_index", "replica"))))
    return rows.groupBy("topic", "partition").agg(F.transform(kept, lambda r: r["replica"]).alias("isr"))


def high_watermark(replicas: DataFrame, now: Column, previous: str | None = None) -> DataFrame:
    """min(log end, least fetched offset in the ISR), never below the previous one."""
    least = F.min(F.when(in_sync(now), F.col("last_fetch_offset")))
    mark = F.least(F.max("log_end_offset"), F.coalesce(least, F.max("log_end_offset")))
    if previous is not None:
        mark = F.greatest(mark, F.max(previous))
    return replicas.groupBy("topic", "partition").agg(mark.alias("high_watermark"))


def acknowledged(acks: DataFrame, level: str) -> DataFrame:
    """By (topic, partition): replicas, acks and whether the level one, quorum, all or eventual is met; acks has a boolean `acked`."""
    out = acks.groupBy("topic", "partition").agg(F.count("*").alias("replicas"), F.count_if("acked").alias("acks"))
    need = {"one": F.lit(1), "quorum": F.floor(F.col("replicas") / 2) + 1, "all": F.col("replicas"), "eventual": F.lit(0)}[level]
    return out.withColumn("met", F.col("acks") >= need)


def replica_lag(replicas: DataFrame) -> DataFrame:
    return replicas.withColumn("lag", F.col("log_end_offset") - F.col("last_fetch_offset"))


def conflict_type(local: str = "local", remote: str = "remote") -> Column:
    """value, key, timestamp or header: the first difference of two message structs; null without one or without a side."""
    a, b = F.col(local), F.col(remote)
    found = (
        F.when(~bytes_equal(a["value"], b["value"]), "value")
        .when(~bytes_equal(a["key"], b["key"]), "key")
        .when(~a["ts"].eqNullSafe(b["ts"]), "timestamp")
        .when(~headers_equal(a["headers"], b["headers"]), "header")
    )
    return F.when(a.isNotNull() & b.isNotNull(), found)


def pair_versions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(topic, partition, offset, local, remote) of two logs; a missing side is null."""
    at = ["topic", "partition", "offset"]
    l = local.select(*at, F.struct(*local.columns).alias("local"))
    return l.join(remote.select(*at, F.struct(*remote.columns).alias("remote")), at, "full")


def _last(a: Column, b: Column) -> Column:
    return F.when(b["ts"] > a["ts"], "remote").when(a["ts"] > b["ts"], "local").when(b["offset"] > a["offset"], "remote").otherwise("local")


def winner(strategy: str, local: str = "local", remote: str = "remote") -> Column:
    """struct(side, confidence); last_write, first_write, creation_time, priority, vector_clock. Equal clocks have no winner."""
    a, b = F.col(local), F.col(remote)
    if strategy == "last_write":
        side, sure = _last(a, b), F.lit(0.8)
    elif strategy == "first_write":
        side = F.when(b["ts"] < a["ts"], "remote").when(a["ts"] < b["ts"], "local").when(a["offset"] < b["offset"], "local").otherwise("remote")
        sure = F.lit(0.8)
    elif strategy == "creation_time":
        x, y = creation_time(a["headers"], a["ts"]), creation_time(b["headers"], b["ts"])
        side, sure = F.when(y > x, "remote").when(x > y, "local").otherwise(_last(a, b)), F.when(x == y, 0.6).otherwise(0.9)
    elif strategy == "priority":
        p, q = priority(a["headers"]), priority(b["headers"])
        both = (p > 0) & (q > 0)
        side, sure = F.when(both, F.when(p > q, "local").otherwise("remote")).otherwise(_last(a, b)), F.when(both, 0.95).otherwise(0.8)
    elif strategy == "vector_clock":
        order = compare_clocks(vector_clock(a["headers"]), vector_clock(b["headers"]))
        side, sure = F.when(order.isin("before", "concurrent"), "remote").when(order == "after", "local"), F.when(order == "concurrent", 0.5).when(order != "equal", 0.9)
    else:
        raise ValueError(strategy)
    return F.struct(side.alias("side"), sure.cast("double").alias("confidence"))


def resolve(pairs: DataFrame, strategy: str, local: str = "local", remote: str = "remote") -> DataFrame:
    """Pairs in conflict with their type, the winning side, its message and the confidence."""
    rows = pairs.withColumn("conflict", conflict_type(local, remote)).where("conflict is not null").withColumn("_w", winner(strategy, local, remote))
    message = F.when(F.col("_w.side") == "local", F.col(local)).when(F.col("_w.side") == "remote", F.col(remote))
    return rows.withColumn("side", F.col("_w.side")).withColumn("confidence", F.col("_w.confidence")).withColumn("resolved", message).drop("_w")


def replay(commands: DataFrame, key: list[str], order: list[str], removed: Column) -> DataFrame:
    """State after a log of commands: the last one of each key, without removed keys."""
    from .log import compact

    return compact(commands, key, order, removed)


def commit_index(matches: DataFrame, by: list[str], index: str = "match_index") -> DataFrame:
    """The highest index a majority has reached: the element at n / 2 of the sorted ones, from above."""
    top = F.sort_array(F.collect_list(index), asc=False)
    return matches.groupBy(*by).agg(F.get(top, F.floor(F.count("*") / 2).cast("int")).alias("commit_index"))


def _event(kind: str, when: Column, **data: Column) -> Column:
    body = F.to_json(F.struct(*[v.alias(k) for k, v in data.items()]))
    return F.when(when, F.struct(F.lit(kind).alias("type"), body.alias("data")))


def partition_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two states of the partition table (topic, partition, leader, replicas, isr, high_watermark): a row an event
    (topic, partition, type, data as JSON), of added and removed partitions, leaders, in-sync sets and high watermarks that moved.

    Both states meet in one full join by partition; partitions that stayed as they were give no row.
    """
    b, a = before.select("topic", "partition", F.struct("leader", "replicas", "isr", "high_watermark").alias("b")), after.select("topic", "partition", F.struct("leader", "replicas", "isr", "high_watermark").alias("a"))
    was, now, both = F.col("b").isNotNull(), F.col("a").isNotNull(), F.col("b").isNotNull() & F.col("a").isNotNull()

    def moved(name: str) -> Column:
        return both & ~F.col(f"b.{name}").eqNullSafe(F.col(f"a.{name}"))

    events = F.array(
        _event("partition_added", now & ~was, leader=F.col("a.leader"), replicas=F.col("a.replicas")),
        _event("partition_removed", was & ~now, leader=F.col("b.leader")),
        _event("leader_changed", moved("leader"), old_leader=F.col("b.leader"), new_leader=F.col("a.leader")),
        _event("isr_changed", moved("isr"), new_isr=F.col("a.isr")),
        _event("high_watermark_updated", moved("high_watermark"), high_watermark=F.col("a.high_watermark")),
    )
    return b.join(a, ["topic", "partition"], "full").select("topic", "partition", F.inline(F.filter(events, lambda e: e.isNotNull())))


def replica_events(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """Replicas that fell out of sync (replica_lag, with how far) or are in sync again (replica_caught_up) between two replica tables."""
    key = ["topic", "partition", "replica"]
    was = before.select(*key, in_sync(now).alias("_was"))
    rows = after.withColumn("_is", in_sync(now)).join(was, key)
    behind = F.col("log_end_offset") - F.col("last_fetch_offset")
    events = F.array(
        _event("replica_lag", F.col("_was") & ~F.col("_is"), replica=F.col("replica"), lag_messages=behind),
        _event("replica_caught_up", ~F.col("_was") & F.col("_is"), replica=F.col("replica")),
    )
    return rows.select("topic", "partition", F.inline(F.filter(events, lambda e: e.isNotNull())))


def conflict_events(pairs: DataFrame, strategy: str) -> DataFrame:
    """A conflict_detected and a conflict_resolved event for each pair of messages (topic, partition, offset, local, remote) that differ; no resolution where no side wins."""
    rows = pairs.withColumn("_type", conflict_type()).where("_type is not null").withColumn("_won", winner(strategy))
    events = F.array(
        _event("conflict_detected", F.lit(True), offset=F.col("offset"), conflict_type=F.col("_type")),
        _event("conflict_resolved", F.col("_won.side").isNotNull(), offset=F.col("offset"), strategy=F.lit(strategy), side=F.col("_won.side")),
    )
    return rows.select("topic", "partition", F.inline(F.filter(events, lambda e: e.isNotNull())))
