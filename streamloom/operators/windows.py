"""Time windows as column expressions, aligned to 0001-01-01; they work on batch and streaming input alike."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interval, origin_offset
from .running import running


@dataclass(frozen=True)
class Tumbling:
    size: timedelta

    def column(self, ts: Column) -> Column | None:
        return F.window(ts, interval(self.size), interval(self.size), interval(origin_offset(self.size)))


@dataclass(frozen=True)
class Sliding:
    """Every window [start, start + size) that holds ts; starts are multiples of slide."""

    size: timedelta
    slide: timedelta

    def column(self, ts: Column) -> Column | None:
        return F.window(ts, interval(self.size), interval(self.slide), interval(origin_offset(self.slide)))


@dataclass(frozen=True)
class Session:
    """Rows of a key no more than `gap` apart (inclusive); a session ends with its last row."""

    gap: timedelta

    def column(self, ts: Column) -> Column | None:
        return F.session_window(ts, interval(self.gap))


@dataclass(frozen=True)
class Global:
    """One window that never ends."""

    def column(self, ts: Column) -> Column | None:
        return None


Window = Tumbling | Sliding | Session | Global


@dataclass
class WindowConfig:
    allowed_lateness: timedelta = timedelta(seconds=10)
    retention: timedelta = timedelta(hours=1)
    cleanup_interval: timedelta = timedelta(minutes=5)
    #: Gives event time from a row.
    timestamp: Column | None = None


@dataclass
class WindowRegistry:
    """Windows by name; a name is taken once."""

    windows: dict[str, Window] = field(default_factory=dict)

    def create(self, name: str, window: Window) -> Window:
        if name in self.windows:
            raise ValueError(f"window {name} exists")
        self.windows[name] = window
        return window

    def assign(self, df: DataFrame, name: str, ts: str = "ts") -> DataFrame:
        """One row a window that a row falls into, with a column `window` (null for a global one)."""
        if name not in self.windows:
            raise KeyError(name)
        w = self.windows[name].column(F.col(ts))
        return df.withColumn("window", F.lit(None).cast("struct<start:timestamp,end:timestamp>") if w is None else w)


def expired(windows: DataFrame, watermark: Column, lateness: timedelta, gap: timedelta = timedelta(0)) -> DataFrame:
    """Rows whose window.end (and gap, for sessions) plus lateness lies before the watermark."""
    return windows.where(F.col("window.end") + F.expr(f"interval {interval(gap + lateness)}") < watermark)


def count_trigger(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Rows at which a trigger that fires from the n-th row of a (key, window) on would fire, with the running count."""
    return running(df, keys, order, running_count=("count", None)).where(F.col("running_count") >= n)
