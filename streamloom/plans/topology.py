"""A fluent builder whose steps are DataFrame operations; the same topology runs over batch and streaming input.

Functions are Columns (or column-valued lambdas) so that Catalyst sees them; opaque Python goes through mapInPandas, on
request only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import interval
from ..operators import aggregates, joins
from ..operators.windows import Global, Session, Sliding, Tumbling, Window, WindowConfig, WindowRegistry

Exprs = Callable[[DataFrame], DataFrame]


class StreamBuilder:
    """Named sources, streams over them, and named windows."""

    def __init__(self, name: str = "topology", config: WindowConfig | None = None):
        self.name, self.config = name, config or WindowConfig()
        self.sources: dict[str, DataFrame] = {}
        self.sinks: dict[str, Stream] = {}
        self.windows = WindowRegistry()

    def source(self, *topics: str, data: DataFrame | None = None, partitions: list[int] | None = None, key: str = "key", ts: str = "ts", order: tuple[str, ...] | None = None) -> Stream:
        """The rows of one table, or of registered sources by name; `partitions` restricts a log; event time is `ts`, or what the configuration takes it from."""
        if data is None:
            if not topics:
                raise ValueError("a source needs a table or topics")
            missing = [t for t in topics if t not in self.sources]
            if missing:
                raise KeyError(f"unknown topics {missing}")
            data = self.sources[topics[0]]
            for t in topics[1:]:
                data = data.unionByName(self.sources[t])
        elif topics and "topic" in data.columns:
            data = data.where(F.col("topic").isin(list(topics)))
        if partitions is not None:
            data = data.where(F.col("partition").isin(partitions))
        if self.config.timestamp is not None:
            data = data.withColumn(ts, self.config.timestamp)
        return Stream(self, data, key, ts, order or (ts,))

    def register(self, topic: str, data: DataFrame) -> None:
        self.sources[topic] = data

    def route(self, topic: str) -> DataFrame:
        """The source a topic belongs to."""
        if topic not in self.sources:
            raise KeyError(topic)
        return self.sources[topic]

    @staticmethod
    def merge(*streams: Stream) -> Stream | None:
        """All rows of all streams; none of none."""
        if not streams:
            return None
        out = streams[0]
        for s in streams[1:]:
            out = out._with(out.df.unionByName(s.df))
        return out

    def build(self) -> dict[str, DataFrame]:
        """The DataFrame of every sink; at least one source and one sink."""
        if not self.sinks:
            raise ValueError("no sink")
        return {k: s.df for k, s in self.sinks.items()}


class Stream:
    def __init__(self, builder: StreamBuilder, df: DataFrame, key: str, ts: str, order: tuple[str, ...]):
        self.builder, self.df, self.key, self.ts, self.order = builder, df, key, ts, order

    def _with(self, df: DataFrame, key: str | None = None) -> Stream:
        return Stream(self.builder, df, key or self.key, self.ts, self.order)

    def map(self, *columns: Column | str, drop_null: str | None = None) -> Stream:
        """Projection; rows whose column `drop_null` is null go."""
        df = self.df.select(*columns)
        return self._with(df if drop_null is None else df.where(F.col(drop_null).isNotNull()))

    def with_columns(self, **columns: Column) -> Stream:
        return self._with(self.df.withColumns(columns))

    def map_rows(self, fn: Callable[[Iterable], Iterable], schema: str) -> Stream:
        """Opaque Python over batches of rows (pandas), for what Columns cannot say."""
        return self._with(self.df.mapInPandas(fn, schema))

    def filter(self, condition: Column | str) -> Stream:
        return self._with(self.df.where(condition))

    def flat_map(self, items: Column, name: str, keep: list[str] | None = None) -> Stream:
        """One row an item of an array column."""
        return self._with(self.df.select(*(keep if keep is not None else self.df.columns), F.explode(items).alias(name)))

    def key_by(self, key: str) -> Stream:
        return self._with(self.df, key)

    def peek(self, name: str, *metrics: Column) -> Stream:
        """Rows pass; the metrics are observed on the way."""
        return self._with(self.df.observe(name, *(metrics or (F.count(F.lit(1)).alias("records"),))))

    def branch(self, *conditions: Column) -> list[Stream]:
        """One stream a condition; a row goes to every branch whose condition holds."""
        return [self.filter(c) for c in conditions]

    def chain(self, *steps: Exprs) -> Stream:
        df = self.df
        for step in steps:
            df = df.transform(step)
        return self._with(df)

    def merge(self, *others: Stream) -> Stream:
        return StreamBuilder.merge(self, *others)

    def watermark(self, lateness: timedelta | None = None) -> Stream:
        """Event-time lateness; batch input is not affected."""
        return self._with(self.df.withWatermark(self.ts, interval(lateness or self.builder.config.allowed_lateness)))

    def window(self, size: timedelta | str) -> WindowedStream:
        """Tumbling windows of a size, or the named window."""
        return WindowedStream(self, self.builder.windows.windows[size] if isinstance(size, str) else Tumbling(size))

    def sliding_window(self, size: timedelta, slide: timedelta) -> WindowedStream:
        return WindowedStream(self, Sliding(size, slide))

    def session_window(self, gap: timedelta) -> WindowedStream:
        return WindowedStream(self, Session(gap))

    def global_window(self) -> WindowedStream:
        return WindowedStream(self, Global())

    def join(self, other: Stream, within: timedelta, how: str = "inner", left_key: str | None = None, right_key: str | None = None) -> JoinedStream:
        left, right = (s.watermark() if s.df.isStreaming else s for s in (self, other))
        return JoinedStream(self.builder, joins.interval_join(left.df, right.df, left_key or self.key, right_key or other.key, within, how, self.ts, other.ts), self)

    def inner_join(self, other: Stream, within: timedelta, **keys: str) -> JoinedStream:
        return self.join(other, within, "inner", **keys)

    def left_join(self, other: Stream, within: timedelta, **keys: str) -> JoinedStream:
        return self.join(other, within, "left", **keys)

    def right_join(self, other: Stream, within: timedelta, **keys: str) -> JoinedStream:
        return self.join(other, within, "right", **keys)

    def full_join(self, other: Stream, within: timedelta, **keys: str) -> JoinedStream:
        return self.join(other, within, "full", **keys)

    def join_latest(self, other: Stream, how: str = "left") -> JoinedStream:
        return JoinedStream(self.builder, joins.latest_join(self.df, other.df, self.key, list(other.order), how), self)

    def process(self, processor, output: str, mode: str = "append", time_mode: str = "none", initial: DataFrame | None = None) -> Stream:
        """A stateful processor (pyspark StatefulProcessor) by key."""
        state = {} if initial is None else {"initialState": initial.groupBy(self.key)}
        return self._with(self.df.groupBy(self.key).transformWithState(processor, output, mode, time_mode, **state))

    def to(self, topic: str) -> Stream:
        self.builder.sinks[topic] = self
        return self


class WindowedStream:
    def __init__(self, stream: Stream, window: Window):
        self.stream, self.kind = stream, window

    def aggregate(self, **aggregates_: Column) -> Stream:
        """key, window_start, window_end and the aggregates."""
        s = self.stream
        return s._with(aggregates.windowed(s.df, self.kind, [s.key], s.ts, **aggregates_))

    def _one(self, function: str, value: str | None = None, name: str | None = None) -> Stream:
        return self.aggregate(**{name or function: aggregates.named(function, value, self.stream.order)})

    def count(self) -> Stream:
        return self._one("count")

    def sum(self, value: str) -> Stream:
        return self._one("sum", value)

    def avg(self, value: str) -> Stream:
        return self._one("avg", value)

    def min(self, value: str) -> Stream:
        return self._one("min", value)

    def max(self, value: str) -> Stream:
        return self._one("max", value)

    def first(self, value: str) -> Stream:
        return self._one("first", value)

    def last(self, value: str) -> Stream:
        return self._one("last", value)

    def reduce(self, value: str, zero: Column, step: Callable[[Column, Column], Column], name: str = "reduced") -> Stream:
        """A custom fold in event-time order."""
        return self.aggregate(**{name: aggregates.fold(value, list(self.stream.order), zero, step)})

    def trigger_count(self, n: int) -> Stream:
        """Batch form of a count trigger: rows from the n-th of each key and window on, with the running count."""
        from ..operators.windows import count_trigger

        s = self.stream
        column = self.kind.column(F.col(s.ts))
        df = s.df if column is None else s.df.withColumn("window", column)
        keys = [s.key] if column is None else [s.key, "window"]
        return s._with(count_trigger(df, keys, list(s.order), n))


class JoinedStream:
    """Pairs of rows: structs l and r (columns l_x and r_x on streams)."""

    def __init__(self, builder: StreamBuilder, df: DataFrame, left: Stream):
        self.builder, self.df, self.left = builder, df, left

    def select(self, *columns: Column | str, key: str | None = None, ts: str | None = None) -> Stream:
        return Stream(self.builder, self.df.select(*columns), key or self.left.key, ts or self.left.ts, (ts or self.left.ts,))
