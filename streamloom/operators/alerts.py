"""Alert rules over metric tables: conditions, the state machine as islands in time, ordering, grouping, routing."""

from __future__ import annotations

import re

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import alert_id, condition_holds, group_key, interval, merge_labels, micros, severity_weight

RULE = "rule string, query string, condition string, threshold double, hold_us long, severity string, labels map<string,string>"
#: Built-in rules (name, metric, condition, default threshold, held for, severity).
BUILT_IN = (
    ("HighCPUUsage", "cpu_usage_percent", "gt", 80.0, timedelta(minutes=5), "warning"),
    ("HighMemoryUsage", "memory_usage_bytes", "gt", 1e9, timedelta(minutes=5), "warning"),
    ("HighErrorRate", "error_rate_percent", "gt", 5.0, timedelta(minutes=2), "error"),
    ("ServiceDown", "up", "lt", 1.0, timedelta(minutes=1), "critical"),
)
RESOLVED_KEPT = timedelta(minutes=5)
REPEAT_INTERVAL = timedelta(hours=1)


def rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rules from (name, metric, condition, threshold, held for, severity[, labels])."""
    return spark.createDataFrame([(r[0], r[1], r[2], float(r[3]), micros(r[4]), r[5], r[6] if len(r) > 6 else {}) for r in rows], RULE)


def evaluate(rule_table: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every rule with every sample of its metric (metric, labels, ts, value) and `holds`; a rule without any sample stays, with null value.

    Rules are a small control table; metrics are scanned once.
    """
    m = metrics.select("metric", F.col("labels").alias("metric_labels"), "ts", "value")
    joined = rule_table.join(m, F.col("query") == F.col("metric"), "left")
    none = F.create_map().cast("map<string,string>")
    holds = condition_holds(F.col("value"), F.col("condition"), F.col("threshold"))
    found = F.coalesce("metric_labels", none)
    return joined.withColumn("holds", holds).withColumn("alert_id", alert_id(F.col("rule"), found)).withColumn("alert_labels", merge_labels(F.coalesce("labels", none), found))


def episodes(evaluated: DataFrame, keys: list[str], ts: str = "ts", hold: Column | str = "hold_us") -> DataFrame:
    """One row a stretch of samples that hold without a break: starts_at, last_true_at, ends_at (first sample after it), fired_at, status.

    pending from its first sample; firing at the first one at least `hold` after that; inactive once a later sample no
    longer holds.  A stretch that ends before firing was only pending: it is removed and not in the result.
    """
    order = W.partitionBy(*keys).orderBy(ts)
    before = F.coalesce(F.lag("holds").over(order), F.lit(False))
    marked = evaluated.withColumn("_new", (F.col("holds") & ~before).cast("int")).withColumn("_next", F.lead(ts).over(order))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).where("holds")
    start = island.withColumn("_start", F.min(ts).over(W.partitionBy(*keys, "_island")))
    held = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp")) >= (F.col(hold) if isinstance(hold, str) else hold)
    out = start.groupBy(*keys, "_island").agg(
        F.min(ts).alias("starts_at"), F.max(ts).alias("last_true_at"), F.max_by("_next", ts).alias("ends_at"), F.min(F.when((F.col(ts) > F.col("_start")) & held, F.col(ts))).alias("fired_at"), F.count("*").alias("samples")
    )
    status = F.when(F.col("fired_at").isNull(), "pending").when(F.col("ends_at").isNull(), "firing").otherwise("inactive")
    return out.withColumn("status", status).drop("_island").where((F.col("status") != "pending") | F.col("ends_at").isNull())


def active_order(alerts: DataFrame) -> DataFrame:
    """Most severe first, then longest standing."""
    return alerts.orderBy(F.desc(severity_weight(F.col("severity"))), "starts_at")


def unexpired(alerts: DataFrame, now: Column, kept: timedelta = RESOLVED_KEPT) -> DataFrame:
    """Without resolved alerts older than `kept`."""
    gone = (F.col("status") == "inactive") & (F.col("ends_at") + F.expr(f"interval {interval(kept)}") < now)
    return alerts.where(~F.coalesce(gone, F.lit(False)))


def by_severity(alerts: DataFrame) -> DataFrame:
    """n, firing and resolved counts, and the group's status, by severity."""
    firing = F.count_if(F.col("status") == "firing")
    return alerts.groupBy("severity").agg(F.count("*").alias("n"), firing.alias("firing"), F.count_if(F.col("status") == "inactive").alias("resolved"), F.when(firing > 0, "firing").otherwise("resolved").alias("group_status"))


def colour(alerts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """danger, warning or good by the highest severity among firing alerts."""
    top = F.max(F.when(F.col("status") == "firing", severity_weight(F.col("severity"))).otherwise(1))
    return alerts.groupBy(*(by or [])).agg(F.when(top == 4, "danger").when(top >= 2, "warning").otherwise("good").alias("colour"))


def route(alerts: DataFrame, routes: list[tuple[str, dict[str, str | re.Pattern], list[str]]], labels: str = "alert_labels") -> DataFrame:
    """receiver and group_key of the first route (receiver, labels that must be equal or match an expression whole, grouping labels) that matches; else `default`, grouped by alertname."""
    named = merge_labels(F.create_map(F.lit("alertname"), F.col("rule")), F.coalesce(labels, F.create_map().cast("map<string,string>")))
    receiver, key = F.lit("default"), group_key(F.col("_l"), ["alertname"])
    for name, match, by in reversed(routes):
        hit = F.lit(True)
        for k, v in match.items():
            own = F.col("_l")[k]
            hit = hit & F.coalesce(own.rlike(f"^(?:{v.pattern})$") if isinstance(v, re.Pattern) else own == v, F.lit(False))
        receiver, key = F.when(hit, F.lit(name)).otherwise(receiver), F.when(hit, group_key(F.col("_l"), by)).otherwise(key)
    return alerts.withColumn("_l", named).withColumn("receiver", receiver).withColumn("group_key", key).drop("_l")


def suppress(notifications: DataFrame, keys: list[str], ts: str = "ts", interval_us: int = micros(REPEAT_INTERVAL)) -> DataFrame:
    """Notifications that are sent: none within the repeat interval of the last one sent with the same keys.

    What was sent decides what follows, so each key is walked in time order, batch by batch with the last time carried.
    """
    import numpy as np
    import pandas as pd

    rows = notifications.repartition(*keys).sortWithinPartitions(*keys, ts)

    def run(batches):
        current, last = None, 0
        for pdf in batches:
            at = pd.to_datetime(pdf[ts]).to_numpy("datetime64[us]").astype(np.int64).tolist()
            keep = []
            for k, t in zip(pdf[keys].itertuples(index=False, name=None), at):
                due = k != current or t - last >= interval_us
                if due:
                    current, last = k, t
                keep.append(due)
            yield pdf[np.array(keep, bool)]

    return rows.mapInPandas(run, notifications.schema)


def notification_text(alerts: DataFrame) -> DataFrame:
    """A line of text an alert, as message bodies list them."""
    line = F.format_string("[%s] %s value=%.2f since %s", F.upper("severity"), F.col("rule"), F.col("value"), F.date_format("starts_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return alerts.withColumn("line", line)


def email(alerts: DataFrame, keys: list[str], to: list[str], subject: str | None = None) -> DataFrame:
    """A mail message a group: recipients, subject (by default how many alerts there are) and the lines of its alerts."""
    title = F.format_string("Alert Notification - %d alerts", F.count("*")) if subject is None else F.lit(subject)
    text = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    head = F.concat(F.lit(f"To: {','.join(to)}\r\nSubject: "), title, F.lit("\r\n\r\n"))
    return notification_text(alerts).groupBy(*keys).agg(F.concat(head, text).alias("message"))


def slack(alerts: DataFrame, keys: list[str], channel: str, username: str, title: str) -> DataFrame:
    """A JSON body a group for a chat webhook: one alert's name and status or how many fire and are resolved, coloured by the worst that fires."""
    firing, resolved = F.count_if(F.col("status") == "firing"), F.count_if((F.col("status") == "inactive") & F.col("ends_at").isNotNull())
    top = F.max(F.when(F.col("status") == "firing", severity_weight(F.col("severity"))).otherwise(1))
    one = F.concat(F.lit("Alert: "), F.max("rule"), F.lit(" - "), F.max("status"))
    groups = alerts.groupBy(*keys).agg(
        F.when(F.count("*") == 1, one).otherwise(F.format_string("%d firing, %d resolved alerts", firing, resolved)).alias("_text"),
        F.when(top == 4, "danger").when(top >= 2, "warning").otherwise("good").alias("_colour"),
    )
    part = F.array(F.struct(F.col("_colour").alias("color"), F.lit(title).alias("title")))
    body = F.struct(F.lit(channel).alias("channel"), F.lit(username).alias("username"), F.col("_text").alias("text"), part.alias("attachments"))
    return groups.select(*keys, F.to_json(body).alias("body"))


def inhibit(alerts: DataFrame, source: dict[str, str], target: dict[str, str], equal: list[str], labels: str = "alert_labels") -> DataFrame:
    """Alerts without those that a firing alert keeps silent: targets (labels as given) for which a source fires with the same `equal` labels.

    `severity` and `alertname` count as labels; a label that both lack is the same, and an alert that is itself a source stays.
    """
    named = merge_labels(F.create_map(F.lit("alertname"), F.col("rule"), F.lit("severity"), F.col("severity")), F.coalesce(labels, F.create_map().cast("map<string,string>")))
    rows = alerts.withColumn("_l", named)

    def matches(match: dict[str, str]) -> Column:
        hit = F.lit(True)
        for k, v in match.items():
            hit = hit & F.coalesce(F.col("_l")[k] == v, F.lit(False))
        return hit

    same = [F.coalesce(F.concat(F.lit("="), F.col("_l")[k]), F.lit("")).alias(f"_e{i}") for i, k in enumerate(equal)]
    marks = [f"_e{i}" for i in range(len(equal))]
    silencing = rows.where(matches(source) & (F.col("status") == "firing")).select(*same, F.lit(True).alias("_silent")).distinct()
    own = rows.select("*", *same, (matches(target) & ~matches(source)).alias("_target"))
    joined = own.join(silencing, marks, "left") if marks else own.join(silencing, F.col("_target"), "left")
    return joined.where(~F.col("_target") | F.col("_silent").isNull()).select(*alerts.columns)


def payload(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """A JSON body a group, for a webhook called from foreachBatch."""
    body = F.struct("rule", "severity", "status", "value", "starts_at")
    return alerts.groupBy(*keys).agg(F.to_json(F.struct(F.count("*").alias("n"), F.sort_array(F.collect_list(body)).alias("alerts"))).alias("body"))
