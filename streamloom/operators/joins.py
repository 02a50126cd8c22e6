"""Joins bounded in time, and lookups of the latest row."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interval, micros
from .running import running


def _near(l_ts: Column, r_ts: Column, within: timedelta) -> Column:
    bound = F.expr(f"interval {interval(within)}")
    return (r_ts >= l_ts - bound) & (r_ts <= l_ts + bound)


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, within: timedelta, how: str = "inner", left_ts: str = "ts", right_ts: str = "ts") -> DataFrame:
    """Equal keys and times at most `within` apart (inclusive): columns l (struct of the left row) and r.

    Streams join by Spark's own interval join (both sides need a watermark).  In batch, time is cut into slots of the bound's
    length, the side that is not preserved goes to its slot and both neighbours, and the slot joins as a second key:
    a busy key is spread over its slots, and every pair meets in exactly one.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(how)
    if left.isStreaming or right.isStreaming:
        l, r = left.alias("l"), right.alias("r")
        on = (F.col(f"l.{left_key}") == F.col(f"r.{right_key}")) & _near(F.col(f"l.{left_ts}"), F.col(f"r.{right_ts}"), within)
        return l.join(r, on, how).select(*[F.col(f"l.{c}").alias(f"l_{c}") for c in left.columns], *[F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns])
    size = max(1, micros(within))

    def slot(ts: str) -> Column:
        return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(size)).cast("long")

    def fixed(df: DataFrame, key: str, ts: str, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name), F.col(key).alias(f"{name}_key"), F.col(ts).alias(f"{name}_ts"), slot(ts).alias(f"{name}_slot"))

    def spread(df: DataFrame, key: str, ts: str, name: str) -> DataFrame:
        slots = F.array(slot(ts) - 1, slot(ts), slot(ts) + 1)
        return df.select(F.struct(*df.columns).alias(name), F.col(key).alias(f"{name}_key"), F.col(ts).alias(f"{name}_ts"), F.explode(slots).alias(f"{name}_slot"))

    on = (F.col("l_key") == F.col("r_key")) & (F.col("l_slot") == F.col("r_slot")) & _near(F.col("l_ts"), F.col("r_ts"), within)
    if how in ("inner", "left", "full"):
        out = fixed(left, left_key, left_ts, "l").join(spread(right, right_key, right_ts, "r"), on, "inner" if how == "inner" else "left").select("l", "r")
        if how != "full":
            return out
        # Right rows without a partner: only the left side's keys and times move again.
        alone = fixed(right, right_key, right_ts, "r").join(spread(left, left_key, left_ts, "l").drop("l"), on, "left_anti")
        return out.unionByName(alone.select("r"), allowMissingColumns=True)
    return spread(left, left_key, left_ts, "l").join(fixed(right, right_key, right_ts, "r"), on, "right").select("l", "r")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")


def latest_join(left: DataFrame, right: DataFrame, key: str, order: list[str], how: str = "left") -> DataFrame:
    """Left rows with the latest right row of their key (a table lookup): columns l, r."""
    table = latest(right, key, order)
    return left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("_k")).join(table.select(F.struct(*table.columns).alias("r"), F.col(key).alias("_k")), "_k", how).select("l", "r")


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Left rows with `as_of`: the right value at or before their time (its last one that is not null); no range join.

    Both sides are sorted together, block by block of time, with the last value before a block in front of it.
    """
    row = F.struct(*left.columns)
    r = right.select(key, ts, F.lit(0).alias("_right_first"), F.col(value).alias("_v"))
    both = left.select(key, ts, F.lit(1).alias("_right_first"), row.alias("l")).unionByName(r, allowMissingColumns=True)
    out = running(both, [key], [ts, "_right_first"], as_of=("last", F.col("_v")))
    return out.where("_right_first = 1").select("l.*", "as_of")


def member_of(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """Rows that have a match (set membership)."""
    return df.join(members, on, "left_semi")
