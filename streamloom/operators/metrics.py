"""Operational metrics over long tables (name, kind, labels, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import running

#: Default bounds in seconds, and message sizes in bytes.
DEFAULT_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SIZE_BUCKETS = (100, 1024, 10 * 1024, 100 * 1024, 1024 * 1024, 10 * 1024 * 1024)
PERCENTILES = (0.5, 0.9, 0.95, 0.99)
SAMPLES = 1000


def histogram(df: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = DEFAULT_BUCKETS) -> DataFrame:
    """keys, le, bucket_count (values <= le; +Inf last), total_count, total_sum: one pass, one row a group before it unfolds."""
    each = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    out = df.groupBy(*keys).agg(*each, F.count(value).alias("total_count"), F.sum(value).alias("total_sum"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total_count").alias("bucket_count")))
    return out.select(*keys, F.inline(F.array(*rows)), "total_count", "total_sum")


def counter(df: DataFrame, keys: list[str], delta: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(delta).alias("value"))


def gauge(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value set."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))


def gauge_deltas(df: DataFrame, keys: list[str], delta: str, order: list[str]) -> DataFrame:
    """Values after each addition or subtraction."""
    return running(df, keys, order, value_after=("sum", F.col(delta)))


def timer(df: DataFrame, keys: list[str], nanos: str) -> DataFrame:
    """count, sum and mean; the mean is cut to whole nanoseconds."""
    return df.groupBy(*keys).agg(F.count(nanos).alias("n"), F.sum(nanos).alias("total")).withColumn("mean", F.floor(F.col("total") / F.col("n")))


def timer_percentiles(df: DataFrame, keys: list[str], value: str, order: list[str], samples: int = SAMPLES, points: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """keys, p, value over the last `samples` rows of each key: the element at 0-based index int(n * p), no interpolation.

    The tail is cut by rank, which partial limits apply before the shuffle, so a busy key costs `samples` rows a task.
    """
    last = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= samples)
    lists = last.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    point = [F.struct(F.lit(p).alias("p"), F.get("_v", F.least(F.floor(F.size("_v") * F.lit(p)), F.size("_v") - 1).cast("int")).alias(value)) for p in points]
    return lists.select(*keys, F.inline(F.array(*point)))


def rates(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """Change per second against the row before; null for the first row and where no time has passed."""
    rows = running(df, keys, [ts], exclusive=True, _before=("last", F.struct(F.col(ts).alias("t"), F.col(value).alias("v"))))
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_before.t").cast("timestamp"))) / 1e6
    return rows.withColumn("rate", F.when(seconds > 0, (F.col(value) - F.col("_before.v")) / seconds)).drop("_before")


def balance_score(df: DataFrame, count: str, by: list[str] | None = None) -> DataFrame:
    """1 / (1 + cv) of counts, cv by population deviation; 1 without counts or with mean 0. `variance_score` has the variance in its place."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    out = grouped.agg(F.stddev_pop(count).alias("_s"), F.var_pop(count).alias("_v"), F.avg(count).alias("_m"))

    def score(x: str) -> Column:
        return F.when(F.col("_m").isNull() | (F.col("_m") == 0), F.lit(1.0)).otherwise(1 / (1 + F.col(x) / F.col("_m")))

    return out.select(*(by or []), score("_s").alias("balance_score"), score("_v").alias("variance_score"))


def rollup(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of (records, latency, error_rate) rolled up: records add, the highest latency, the mean error rate."""
    return df.groupBy(*(keys or [])).agg(F.sum("records").alias("records"), F.max("latency").alias("latency"), F.avg("error_rate").alias("error_rate"))


def overall_health(df: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    """unhealthy if any is, else degraded if any is, else healthy; unknown counts for nothing."""
    worst = F.max(F.when(F.col(status) == "unhealthy", 2).when(F.col(status) == "degraded", 1).otherwise(0))
    return df.groupBy(*(by or [])).agg(F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy").alias("overall"))


def http_health(code: Column) -> Column:
    """Of a probe's answer: 2xx healthy, another code degraded, none unhealthy."""
    return F.when(code.isNull(), "unhealthy").when(code.between(200, 299), "healthy").otherwise("degraded")


def threshold_health(used: Column, warn: float, fail: float) -> Column:
    """Of a used share."""
    return F.when(used.isNull(), "unknown").when(used >= fail, "unhealthy").when(used >= warn, "degraded").otherwise("healthy")


def recent(df: DataFrame, keys: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= n).drop("_r")


def register(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """(metric, kind, clash) of wanted metrics: get-or-create, where a name with another kind is a clash."""
    known = catalogue.select("metric", F.col("kind").alias("_known"))
    return wanted.join(known, "metric", "left").select("metric", F.coalesce("_known", "kind").alias("kind"), (F.coalesce("_known", "kind") != F.col("kind")).alias("clash"))


def unfold_labels(df: DataFrame, values: str, label: str) -> DataFrame:
    """One labelled gauge row a map entry, as collectors emit per-partition values."""
    return df.select("*", F.explode(values).alias("_k", "value")).withColumn("labels", F.create_map(F.lit(label), F.col("_k"))).drop("_k", values)
