"""State stores as tables: ranges of keys and windows, expiry, merged sessions.

Running queries keep state in Spark's state store; these are the reads and the upkeep that a store offers, over a state
table (a changelog's latest rows, or what the state data source reads).
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interval
from .running import running


def put(state: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """State after changes (key, value, seq): the last one of a key holds, a null value deletes it."""
    rows = state.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "seq")]), "seq").alias("_s"))
    return last.select(key, "_s.*").where("value is not null")


def key_range(state: DataFrame, low, high, key: str = "key") -> DataFrame:
    """Entries with low <= key <= high."""
    return state.where(F.col(key).between(low, high))


def windows_between(state: DataFrame, start: Column, end: Column) -> DataFrame:
    """Entries whose window lies in [start, end]."""
    return state.where((F.col("window_start") >= start) & (F.col("window_end") <= end))


def delete_expired(state: DataFrame, watermark: Column, retention: timedelta = timedelta(0)) -> DataFrame:
    """What stays: windows that end (plus retention) at or after the watermark."""
    return state.where(F.col("window_end") + F.expr(f"interval {interval(retention)}") >= watermark)


def merge_sessions(sessions: DataFrame, keys: list[str], gap: timedelta, updated: str = "updated", value: str = "value") -> DataFrame:
    """Sessions (window_start, window_end) of a key no more than `gap` apart become one; the value updated last wins."""
    order = ["window_start", "window_end"]
    seen = running(sessions, keys, order, exclusive=True, _before=("max", F.col("window_end")))
    fresh = F.when(F.col("window_start") <= F.col("_before") + F.expr(f"interval {interval(gap)}"), 0).otherwise(1)
    island = running(seen.withColumn("_new", fresh), keys, order, _island=("sum", F.col("_new")))
    return island.groupBy(*keys, "_island").agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), F.max_by(value, F.struct(updated, "window_start")).alias(value), F.max(updated).alias(updated)).drop("_island")
