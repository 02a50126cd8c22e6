"""Running topologies as Structured Streaming queries, and stateful processors for what windows cannot say."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalar import interval, micros
from ..operators.limits import refill

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; without one a folder under /tmp where driver and executors are one process, an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return (root or "/tmp/checkpoints").rstrip("/")


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", every: timedelta | None = None) -> StreamingQuery:
    """A file sink with exactly-once commits; all that is there now, or a trigger interval."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{micros(every) // 1000} milliseconds") if every else writer.trigger(availableNow=True)
    return writer.start()


def drain(df: DataFrame, name: str = "stream") -> DataFrame:
    """Runs a streaming DataFrame over everything that is there and gives the append-mode result as a table."""
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/streamloom/{name}-{uuid.uuid4().hex}"
    query = to_table(df, f"{root}/data", f"{root}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(df.schema).parquet(f"{root}/data")


def upsert(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Update-mode rows handed to `merge(batch, batch_id)`; batch_id makes a retried batch recognisable."""
    return df.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass(frozen=True)
class RetryPolicy:
    """How often a failed query starts again from its checkpoint, and the growing wait before each time."""

    retries: int = 3
    delay: timedelta = timedelta(milliseconds=100)
    factor: float = 2.0
    most: timedelta = timedelta(seconds=5)

    def delays(self) -> list[timedelta]:
        return [min(self.delay * self.factor**i, self.most) for i in range(self.retries)]


class Application:
    """A topology's sinks as queries: start, stop, metrics.

    With a retry policy, `wait` starts a failed query again from its checkpoint: the file sink commits each batch once.
    """

    def __init__(self, spark: SparkSession, name: str, retry: RetryPolicy | None = None):
        self.spark, self.name, self.retry = spark, name, retry or RetryPolicy(retries=0)
        self._start: dict[str, Callable[[], StreamingQuery]] = {}
        self.sinks: dict[str, DataFrame] = {}
        self.queries: dict[str, StreamingQuery] = {}
        self.on_error: Callable[[str, Exception], None] | None = None

    def set_topology(self, sinks: dict[str, DataFrame]) -> Application:
        if self.is_running():
            raise RuntimeError("running")
        if not sinks:
            raise ValueError("a topology needs a sink")
        self.sinks = dict(sinks)
        return self

    def start(self, every: timedelta | None = None, root: str | None = None) -> None:
        root = root or f"{shared_folder(self.spark)}/streamloom/{self.name}"
        for topic, df in self.sinks.items():
            if not df.isStreaming:
                df.write.mode("overwrite").parquet(f"{root}/{topic}/data")
                continue
            self._start[topic] = partial(to_table, df, f"{root}/{topic}/data", f"{root}/{topic}/checkpoint", every=every)
            self.queries[topic] = self._start[topic]()

    def wait(self) -> None:
        for topic in self.queries:
            delays = self.retry.delays()
            while True:
                try:
                    self.queries[topic].awaitTermination()
                    break
                except Exception as e:
                    if self.on_error is not None:
                        self.on_error(topic, e)
                    if delays:
                        time.sleep(delays.pop(0).total_seconds())
                        self.queries[topic] = self._start[topic]()
                        continue
                    if self.on_error is None:
                        raise
                    break

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()

    def is_running(self) -> bool:
        return any(q.isActive for q in self.queries.values())

    def metrics(self) -> dict[str, dict]:
        """Last progress by sink."""
        return {t: dict(q.lastProgress or {}) for t, q in self.queries.items()}


class StreamCatalog:
    """Streams by name: create, get, list, delete."""

    def __init__(self) -> None:
        self._apps: dict[str, Application] = {}

    def create(self, name: str, app: Application) -> Application:
        if name in self._apps:
            raise ValueError(f"stream {name} exists")
        self._apps[name] = app
        return app

    def get(self, name: str) -> Application:
        return self._apps[name]

    def list(self) -> list[str]:
        return sorted(self._apps)

    def delete(self, name: str) -> None:
        self._apps.pop(name).stop()


def watermarked(df: DataFrame, ts: str = "ts", lateness: timedelta = timedelta(seconds=10)) -> DataFrame:
    return df.withWatermark(ts, interval(lateness))


class CountTriggerProcessor(StatefulProcessor):
    """Emits (key, running count, value sum) for every row of a key from the n-th on."""

    def __init__(self, n: int, value: str):
        self.n, self.value = n, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, total double")

    def handleInputRows(self, key, rows: Iterator, timers) -> Iterator:
        from pyspark.sql import Row

        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for r in rows:
            n, total = n + 1, total + (r[self.value] or 0.0)
            if n >= self.n:
                yield Row(key=key[0], running_count=n, running_sum=total)
        self.state.update((n, total))

    def close(self) -> None:
        pass


class TokenBucketProcessor(StatefulProcessor):
    """Emits (key, ts_us, allowed, tokens_left) for every request of a key, in order within a batch."""

    def __init__(self, rate: int, window: timedelta, ts: str):
        self.rate, self.size, self.ts = rate, micros(window), ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens long, last_us long")

    def handleInputRows(self, key, rows: Iterator, timers) -> Iterator:
        from pyspark.sql import Row

        tokens, last = self.state.get() if self.state.exists() else (self.rate, None)
        for at in sorted(int(pd.Timestamp(r[self.ts]).value // 1000) for r in rows):
            last = at if last is None else last
            tokens, last = refill(tokens, last, at, self.rate, self.size, self.rate)
            allowed = tokens > 0
            tokens -= allowed
            yield Row(key=key[0], ts_us=at, allowed=bool(allowed), tokens_left=int(tokens))
        if last is not None:
            self.state.update((int(tokens), int(last)))

    def close(self) -> None:
        pass


class AlertProcessor(StatefulProcessor):
    """The alert state machine by key: rows (ts, holds) give (key, ts_us, status) at each change of status."""

    def __init__(self, hold: timedelta, ts: str, holds: str):
        self.hold, self.ts, self.holds = micros(hold), ts, holds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", "status string, since_us long")

    def handleInputRows(self, key, rows: Iterator, timers) -> Iterator:
        from pyspark.sql import Row

        status, since = self.state.get() if self.state.exists() else ("none", 0)
        for at, holds in sorted((int(pd.Timestamp(r[self.ts]).value // 1000), bool(r[self.holds])) for r in rows):
            new = status
            if holds and status in ("none", "inactive"):
                new, since = "pending", at
            elif holds and status == "pending" and at - since >= self.hold:
                new = "firing"
            elif not holds and status == "firing":
                new = "inactive"
            elif not holds and status == "pending":
                new = "none"
            if new != status:
                status = new
                yield Row(key=key[0], ts_us=at, status="removed" if new == "none" else new)
        self.state.update((status, since))

    def close(self) -> None:
        pass
