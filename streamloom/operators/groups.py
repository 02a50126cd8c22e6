"""Consumer groups: partition assignment, its checks, replica placement, offsets and lag."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import interval

ASSIGNMENT = "group_id string, member_id string, topic string, partition int"


def topic_partitions(topics: DataFrame) -> DataFrame:
    """(topic, partition) of (topic, partitions)."""
    return topics.where("partitions > 0").select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions").cast("int") - 1)).alias("partition"))


def subscriptions(members: DataFrame) -> DataFrame:
    """(group_id, member_id, topic), once each, of (group_id, member_id, subscription)."""
    return members.select("group_id", "member_id", F.explode(F.array_distinct("subscription")).alias("topic"))


def range_assignment(members: DataFrame, topics: DataFrame) -> DataFrame:
    """By topic: members in order get n / m neighbouring partitions each, the first n % m one more."""
    w = W.partitionBy("group_id", "topic")
    subs = subscriptions(members).withColumn("_i", F.row_number().over(w.orderBy("member_id")) - 1).withColumn("_m", F.count("*").over(w))
    own = subs.join(topics, "topic")
    base, extra = F.floor(F.col("partitions") / F.col("_m")), F.col("partitions") % F.col("_m")
    start = F.col("_i") * base + F.least(F.col("_i"), extra)
    size = base + (F.col("_i") < extra).cast("int")
    got = own.withColumn("_a", start.cast("int")).withColumn("_n", size.cast("int")).where("_n > 0")
    return got.select("group_id", "member_id", "topic", F.explode(F.sequence(F.col("_a"), F.col("_a") + F.col("_n") - 1)).alias("partition"))


def round_robin_uniform(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Round robin where all members of a group have one subscription: the i-th partition goes to member i mod m."""
    ranked = members.select("group_id", "member_id").distinct().withColumn("_i", F.row_number().over(W.partitionBy("group_id").orderBy("member_id")) - 1).withColumn("_m", F.count("*").over(W.partitionBy("group_id")))
    parts = subscriptions(members).select("group_id", "topic").distinct().join(topic_partitions(topics), "topic")
    dealt = parts.withColumn("_r", F.row_number().over(W.partitionBy("group_id").orderBy("topic", "partition")) - 1)
    sizes = ranked.select("group_id", "_m").distinct()
    return dealt.join(sizes, "group_id").withColumn("_i", F.col("_r") % F.col("_m")).join(ranked.drop("_m"), ["group_id", "_i"]).select("group_id", "member_id", "topic", "partition")


def _deal(policy: str, parts: list[tuple[str, int]], subscribed: dict[str, set[str]], before: dict[str, list[tuple[str, int]]]) -> dict[str, list[tuple[str, int]]]:
    """One group's assignment by a sequential policy; every partition of a subscribed topic ends up with one member where possible."""
    members = sorted(subscribed)
    parts = sorted(set(parts))
    out: dict[str, list[tuple[str, int]]] = {m: [] for m in members}
    if policy == "round_robin":
        turn = 0
        for p in parts:
            for step in range(len(members)):
                m = members[(turn + step) % len(members)]
                if p[0] in subscribed[m]:
                    out[m].append(p)
                    turn = (turn + step + 1) % len(members)
                    break
        return out
    taken: set[tuple[str, int]] = set()
    there = set(parts)
    for m in members:
        for p in sorted(set(before.get(m, []))):
            if p in there and p[0] in subscribed[m] and p not in taken:
                out[m].append(p)
                taken.add(p)
    target = {m: len(parts) // len(members) + (i < len(parts) % len(members)) for i, m in enumerate(members)}
    if policy == "cooperative":
        for m in members:
            while len(out[m]) > target[m]:
                taken.discard(out[m].pop())
    for p in (p for p in parts if p not in taken):
        able = [m for m in members if p[0] in subscribed[m]]
        if policy == "cooperative":
            able = [m for m in able if len(out[m]) < target[m]] or able
        if able:
            out[min(able, key=lambda m: (len(out[m]), m))].append(p)
    return out


def assign(members: DataFrame, topics: DataFrame, policy: str, previous: DataFrame | None = None) -> DataFrame:
    """round_robin, sticky or cooperative assignment by group.

    Each choice depends on the ones before, so a group is worked through at once; its size is that of its metadata (members
    times subscribed topics), and groups run side by side.
    """
    import pandas as pd

    if policy not in ("round_robin", "sticky", "cooperative"):
        raise ValueError(policy)
    subs = subscriptions(members).join(topics, "topic", "left").select("group_id", "member_id", "topic", F.coalesce("partitions", F.lit(0)).alias("n"), F.lit(0).alias("kind"))
    if previous is not None:
        subs = subs.union(previous.select("group_id", "member_id", "topic", F.col("partition").cast("int"), F.lit(1)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        now, old = pdf[pdf.kind == 0], pdf[pdf.kind == 1]
        subscribed: dict[str, set[str]] = {}
        for m, t in zip(now.member_id, now.topic):
            subscribed.setdefault(m, set()).add(t)
        parts = [(t, i) for t, n in {(t, n) for t, n in zip(now.topic, now.n)} for i in range(int(n))]
        before: dict[str, list[tuple[str, int]]] = {}
        for m, t, p in zip(old.member_id, old.topic, old.n):
            before.setdefault(m, []).append((t, int(p)))
        if not subscribed:
            return pd.DataFrame(columns=["group_id", "member_id", "topic", "partition"])
        rows = [(key[0], m, t, p) for m, got in _deal(policy, parts, subscribed, before).items() for t, p in got]
        return pd.DataFrame(rows, columns=["group_id", "member_id", "topic", "partition"])

    return subs.groupBy("group_id").applyInPandas(run, ASSIGNMENT)


def validate(assignment: DataFrame, members: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows that are wrong, with `problem`: unknown_member, unknown_topic, unknown_partition, not_subscribed, duplicate."""
    m = members.select("group_id", "member_id", F.lit(True).alias("_member")).distinct()
    s = subscriptions(members).withColumn("_subscribed", F.lit(True))
    n = assignment.groupBy("group_id", "topic", "partition").agg(F.count("*").alias("_n"))
    rows = assignment.join(m, ["group_id", "member_id"], "left").join(topics, "topic", "left").join(s, ["group_id", "member_id", "topic"], "left").join(n, ["group_id", "topic", "partition"])
    problem = (
        F.when(F.col("_member").isNull(), "unknown_member")
        .when(F.col("partitions").isNull(), "unknown_topic")
        .when((F.col("partition") < 0) | (F.col("partition") >= F.col("partitions")), "unknown_partition")
        .when(F.col("_subscribed").isNull(), "not_subscribed")
        .when(F.col("_n") > 1, "duplicate")
    )
    return rows.withColumn("problem", problem).where("problem is not null").select("group_id", "member_id", "topic", "partition", "problem")


def unbalanced(assignment: DataFrame, members: DataFrame) -> DataFrame:
    """By group whether counts differ by more than one between at least two members."""
    n = members.select("group_id", "member_id").distinct().join(assignment.groupBy("group_id", "member_id").agg(F.count("*").alias("n")), ["group_id", "member_id"], "left")
    return n.groupBy("group_id").agg(((F.count("*") >= 2) & (F.max(F.coalesce("n", F.lit(0))) - F.min(F.coalesce("n", F.lit(0))) > 1)).alias("unbalanced"))


def expired_members(members: DataFrame, now: Column) -> DataFrame:
    """Members (last_heartbeat, session_timeout_us) that have not been heard of for longer than their timeout."""
    silent = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_heartbeat").cast("timestamp"))
    return members.where(silent > F.col("session_timeout_us"))


def rebalance(assignment: DataFrame, members: DataFrame, topics: DataFrame, now: Column, policy: str = "sticky") -> DataFrame:
    """New assignment after expired members left; `moved` marks partitions that changed hands."""
    gone = expired_members(members, now).select("group_id", "member_id")
    alive = members.join(gone, ["group_id", "member_id"], "left_anti")
    new = assign(alive, topics, policy, assignment) if policy != "range" else range_assignment(alive, topics)
    old = assignment.select("group_id", "topic", "partition", F.col("member_id").alias("was"))
    return new.join(old, ["group_id", "topic", "partition"], "left").withColumn("moved", ~F.col("member_id").eqNullSafe(F.col("was")))


def replica_placement(topics: DataFrame, brokers: DataFrame) -> DataFrame:
    """(topic, partition, replica, broker_id, is_leader): replica j of partition i is on broker (i + j) mod B; leader j = 0."""
    b = brokers.select("broker_id").withColumn("_b", F.row_number().over(W.orderBy("broker_id")) - 1)  # cluster metadata
    n = brokers.agg(F.count("*").alias("_brokers"))
    parts = topic_partitions(topics).join(topics.select("topic", "replication_factor"), "topic").join(F.broadcast(n))  # one row
    rows = parts.where("replication_factor <= _brokers").select("topic", "partition", "_brokers", F.explode(F.sequence(F.lit(0), F.col("replication_factor") - 1)).alias("replica"))
    return rows.withColumn("_b", (F.col("partition") + F.col("replica")) % F.col("_brokers")).join(b, "_b").select("topic", "partition", "replica", "broker_id", (F.col("replica") == 0).alias("is_leader"))


def committed_offsets(commits: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Last commit of each (group_id, topic, partition)."""
    return commits.groupBy("group_id", "topic", "partition").agg(F.max_by("offset", F.struct(*(order or ["commit_ts"]))).alias("offset"))


def consumer_lag(watermarks: DataFrame, committed: DataFrame, group: str) -> DataFrame:
    """high_watermark - committed offset (0 where nothing was committed), by partition."""
    own = committed.where(F.col("group_id") == group).select("topic", "partition", "offset")
    return watermarks.join(own, ["topic", "partition"], "left").select("topic", "partition", (F.col("high_watermark") - F.coalesce("offset", F.lit(0))).alias("lag"))


def idle_since(members: DataFrame, age: timedelta, now: Column) -> DataFrame:
    return members.where(F.col("last_heartbeat") + F.expr(f"interval {interval(age)}") < now)
