"""Readings of a component as metric rows: what collectors emit, in one pass over a table of readings."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import DEFAULT_BUCKETS, SIZE_BUCKETS, histogram

#: One reading: exactly one of the last four is set.
READING = "name string, number double, nanos long, text string, parts map<string,double>"
#: What each collector puts before names and which readings it takes, beside numbers.
COLLECTORS: dict[str, tuple[str, frozenset[str]]] = {
    "system": ("", frozenset()),
    "storage": ("storage_", frozenset()),
    "network": ("network_", frozenset()),
    "raft": ("raft_", frozenset({"nanos", "text"})),
    "stream": ("stream_", frozenset({"nanos"})),
    "consumer_group": ("consumer_group_", frozenset({"parts"})),
    "producer": ("producer_", frozenset({"nanos"})),
    "performance": ("", frozenset({"nanos"})),
    "custom": ("", frozenset({"nanos", "text", "parts"})),
}
#: Metrics of the performance and application monitors, by kind.
MONITORS: dict[str, dict[str, tuple[str, ...]]] = {
    "performance": {
        "gauge": ("cpu_usage_percent", "goroutine_count", "memory_usage_bytes", "memory_alloc_bytes", "heap_usage_bytes", "connection_count", "request_rate_per_second", "error_rate_percent"),
        "counter": ("gc_count_total", "bytes_received_total", "bytes_sent_total"),
        "histogram": ("gc_pause_seconds", "response_time_seconds"),
    },
    "application": {
        "gauge": ("topic_count", "partition_count", "consumer_group_count", "replication_factor", "sync_replicas"),
        "counter": ("messages_produced_total", "messages_consumed_total"),
        "histogram": ("message_size_bytes", "consumer_lag_seconds"),
    },
}


def readings(spark: SparkSession, values: Mapping[str, Any]) -> DataFrame:
    """A component's answer (numbers, durations, texts, numbers by part) as a table; other types are left out."""
    rows = []
    for name, v in values.items():
        if isinstance(v, timedelta):
            rows.append((name, None, (v.days * 86400 + v.seconds) * 10**9 + v.microseconds * 1000, None, None))
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            rows.append((name, float(v), None, None, None))
        elif isinstance(v, str):
            rows.append((name, None, None, v, None))
        elif isinstance(v, Mapping):
            rows.append((name, None, None, None, {str(k): float(x) for k, x in v.items() if isinstance(x, (int, float)) and not isinstance(x, bool)}))
    return spark.createDataFrame(rows, READING)


def collect(df: DataFrame, collector: str, part: str = "partition", text_label: str = "state") -> DataFrame:
    """Gauges (name, kind, labels, value) of readings: numbers as they are, durations in `_seconds`, a text as `_info` = 1 with the
    text as its label, one gauge a part of a map; readings of a type that the collector does not take are left out."""
    prefix, takes = COLLECTORS[collector]
    none = F.create_map().cast("map<string,string>")
    name = F.concat(F.lit(prefix), F.col("name"))

    def gauge(where: Column, name: Column, labels: Column, value: Column) -> Column:
        return F.when(where, F.array(F.struct(name.alias("name"), F.lit("gauge").alias("kind"), labels.alias("labels"), value.cast("double").alias("value"))))

    options = [gauge(F.col("number").isNotNull(), name, none, F.col("number"))]
    if "nanos" in takes:
        options.append(gauge(F.col("nanos").isNotNull(), F.concat(name, F.lit("_seconds")), none, F.col("nanos") / 1e9))
    if "text" in takes:
        options.append(gauge(F.col("text").isNotNull(), F.concat(name, F.lit("_info")), F.create_map(F.lit(text_label), F.col("text")), F.lit(1.0)))
    if "parts" in takes:
        each = lambda e: F.struct(name.alias("name"), F.lit("gauge").alias("kind"), F.create_map(F.lit(part), e["key"]).alias("labels"), e["value"].alias("value"))
        options.append(F.transform(F.map_entries("parts"), each))
    return df.select(F.inline(F.coalesce(*options)))


def progress(last: Mapping[str, Any]) -> dict[str, Any]:
    """A streaming query's last progress as the stream collector's readings."""
    out: dict[str, Any] = {k: last[k] for k in ("batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond") if last.get(k) is not None}
    out |= {f"{k}_duration": timedelta(milliseconds=v) for k, v in (last.get("durationMs") or {}).items()}
    out["state_rows"] = sum(s.get("numRowsTotal", 0) for s in last.get("stateOperators") or [])
    return out


def message_monitor(messages: DataFrame, produced: str, size: str, lag_seconds: str, by: str = "topic") -> tuple[DataFrame, DataFrame]:
    """Of a message table: counters (name, topic, value) of produced and consumed messages, and histograms (name, topic, le, bucket_count, total_count, total_sum) of sizes and lags."""
    made, used = F.count_if(F.col(produced)), F.count_if(~F.col(produced))
    n = messages.groupBy(by).agg(made.cast("double").alias("messages_produced_total"), used.cast("double").alias("messages_consumed_total"))
    counters = n.unpivot([by], ["messages_produced_total", "messages_consumed_total"], "name", "value").where("value > 0")
    sizes = histogram(messages.where(F.col(produced)), [by], size, tuple(float(b) for b in SIZE_BUCKETS)).withColumn("name", F.lit("message_size_bytes"))
    lags = histogram(messages.where(~F.col(produced)), [by], lag_seconds, DEFAULT_BUCKETS).withColumn("name", F.lit("consumer_lag_seconds"))
    return counters, sizes.unionByName(lags)
