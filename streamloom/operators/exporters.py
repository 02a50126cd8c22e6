"""Metric tables as text: the Prometheus exposition format and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_label, format_labels, prometheus_type, sanitize_metric_name


def _number(x: Column) -> Column:
    return F.format_string("%f", x.cast("double"))


def sample_lines(df: DataFrame) -> DataFrame:
    """name, kind, line of counters and gauges (name, kind, labels, value)."""
    name = sanitize_metric_name(F.col("name"))
    value = F.when(F.col("kind") == "counter", F.col("value").cast("long").cast("string")).otherwise(_number(F.col("value")))
    return df.select(name.alias("name"), "kind", F.concat(name, format_labels(F.col("labels")), F.lit(" "), value).alias("line"))


def histogram_lines(df: DataFrame) -> DataFrame:
    """name, kind, line of histograms (name, labels, buckets array<struct<le, n>>, count, total): buckets, +Inf, count, sum."""
    df = df.withColumn("name", sanitize_metric_name(F.col("name")))
    name, labels = F.col("name"), format_labels(F.col("labels"))
    buckets = F.transform("buckets", lambda b: F.concat(name, F.lit("_bucket"), add_label(labels, "le", _number(b["le"])), F.lit(" "), b["n"].cast("string")))
    rest = F.array(
        F.concat(name, F.lit("_bucket"), add_label(labels, "le", F.lit("+Inf")), F.lit(" "), F.col("count").cast("string")),
        F.concat(name, F.lit("_count"), labels, F.lit(" "), F.col("count").cast("string")),
        F.concat(name, F.lit("_sum"), labels, F.lit(" "), _number(F.col("total"))),
    )
    return df.select("name", F.lit("histogram").alias("kind"), F.explode(F.concat(buckets, rest)).alias("line"))


def timer_lines(df: DataFrame) -> DataFrame:
    """name, kind, line of timers (name, labels, count, total_seconds, quantiles map<double,double>)."""
    df = df.withColumn("name", sanitize_metric_name(F.col("name")))
    name, labels = F.col("name"), format_labels(F.col("labels"))
    head = F.array(F.concat(name, F.lit("_count"), labels, F.lit(" "), F.col("count").cast("string")), F.concat(name, F.lit("_sum"), labels, F.lit(" "), _number(F.col("total_seconds"))))
    points = F.transform(F.array_sort(F.map_entries("quantiles")), lambda e: F.concat(name, add_label(labels, "quantile", _number(e["key"])), F.lit(" "), _number(e["value"])))
    return df.select("name", F.lit("timer").alias("kind"), F.explode(F.concat(head, points)).alias("line"))


def exposition(lines: DataFrame) -> DataFrame:
    """One text a metric name: HELP, TYPE and its lines; order the names to get the page."""
    body = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    text = F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.col("name"), F.lit("\n# TYPE "), F.col("name"), F.lit(" "), prometheus_type(F.col("kind")), F.lit("\n"), F.col("body"), F.lit("\n"))
    return lines.groupBy("name").agg(F.min("kind").alias("kind"), body.alias("body")).select("name", text.alias("text"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def pretty(df: DataFrame) -> DataFrame:
    """Console lines: name{labels} (kind): value."""
    return df.select(F.format_string("%s%s (%s): %s", F.col("name"), format_labels(F.col("labels")), F.col("kind"), F.col("value").cast("string")).alias("line"))


def write_all(df: DataFrame, targets: dict[str, str]) -> dict[str, Exception]:
    """Writes a metric table to several places (format -> path); a failure does not stop the others and is returned."""
    failed: dict[str, Exception] = {}
    for fmt, path in targets.items():
        try:
            if fmt == "prometheus":
                exposition(sample_lines(df)).select("text").write.mode("overwrite").text(path)
            else:
                df.write.mode("overwrite").format(fmt).save(path)
        except Exception as e:  # noqa: BLE001  reported to the caller, by target
            failed[fmt] = e
    return failed
