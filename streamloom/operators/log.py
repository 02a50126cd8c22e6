"""The partitioned log as a table: offsets, reads, seeks, watermarks, retention, compaction, snapshots."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import entry_crc, entry_size, interval
from .running import running

PARTITION = ["topic", "partition"]


def assign_offsets(df: DataFrame, order: list[str], base: Column | int = 0, partition: list[str] = PARTITION) -> DataFrame:
    """Dense offsets within each partition, from `base`; a partition is counted in blocks of its order, not in one task."""
    base = F.lit(base) if isinstance(base, int) else base
    return running(df, partition, order, offset=("count", None)).withColumn("offset", F.col("offset") - 1 + base.cast("long"))


def append(batch: DataFrame, order: list[str], ends: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Log rows for a batch (topic, partition, key, value, headers, ts): offsets go on from `ends` (topic, partition, next_offset), missing times are `now`, each row has its CRC."""
    if ends is not None:
        batch = batch.join(ends, PARTITION, "left")
    else:
        batch = batch.withColumn("next_offset", F.lit(0))
    rows = assign_offsets(batch, order, F.coalesce("next_offset", F.lit(0)))
    ts = F.coalesce("ts", now if now is not None else F.current_timestamp())
    return rows.withColumn("ts", ts).withColumn("crc32", entry_crc(F.col("key"), F.col("value"), F.col("headers"))).drop("next_offset")


def read(log: DataFrame, offset: int, max_bytes: int | None = None, max_offset: int | None = None, partition: list[str] = PARTITION, size: Column | None = None) -> DataFrame:
    """Rows of every partition from `offset` on, while their sizes add up to at most max_bytes; always one row at least.

    Every entry has 24 bytes or more, so the budget bounds how many rows of a partition need looking at, however far apart
    their offsets are: the first max_bytes / 24 + 1 by rank, and only over those runs the sum.
    """
    rows = log.where(F.col("offset") >= offset)
    if max_offset is not None:
        rows = rows.where(F.col("offset") < max_offset)
    if max_bytes is None:
        return rows
    size = entry_size(F.col("key"), F.col("value")) if size is None else size
    w = W.partitionBy(*partition).orderBy("offset")
    near = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_bytes // 24 + 1)
    total = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return near.withColumn("_bytes", total).where((F.col("_bytes") <= max_bytes) | (F.col("_n") == 1)).drop("_bytes", "_n")


def in_range(log: DataFrame, offset: int, partition: list[str] = PARTITION) -> DataFrame:
    """By partition whether an offset can be read: the error code of a read, as a column."""
    return watermarks(log, partition).withColumn("readable", (F.lit(offset) >= F.col("log_start")) & (F.lit(offset) < F.col("high_watermark")))


def seek(log: DataFrame, ts: Column, partition: list[str] = PARTITION) -> DataFrame:
    """The last offset at or before a time, by partition."""
    return log.where(F.col("ts") <= ts).groupBy(*partition).agg(F.max("offset").alias("offset"))


def watermarks(log: DataFrame, partition: list[str] = PARTITION) -> DataFrame:
    return log.groupBy(*partition).agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("high_watermark"))


def retain(log: DataFrame, now: Column, keep: timedelta = timedelta(days=7), max_bytes: int = 10 << 30, segment: Column | None = None, partition: list[str] = PARTITION, size: Column | None = None) -> DataFrame:
    """Drops the oldest segments whose last row is older than `keep`, then oldest ones while a partition is larger than max_bytes; never the last.

    Sizes are summed by segment first; the running sum then orders a partition's segments, not its rows.
    """
    size = entry_size(F.col("key"), F.col("value")) if size is None else size
    seg = F.floor(F.col("offset") / 1000) if segment is None else segment
    rows = log.withColumn("_segment", seg)
    by = rows.groupBy(*partition, "_segment").agg(F.max("ts").alias("_last"), F.sum(size).alias("_bytes"))
    order = W.partitionBy(*partition).orderBy("_segment")
    newer = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    older = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    old = F.col("_last") < now - F.expr(f"interval {interval(keep)}")
    judged = by.withColumn("_young", F.max((~old).cast("int")).over(older)).withColumn("_from_here", F.sum("_bytes").over(newer)).withColumn("_newest", F.max("_segment").over(W.partitionBy(*partition)))
    kept = judged.where((F.col("_segment") == F.col("_newest")) | ((F.col("_young") == 1) & (F.col("_from_here") <= max_bytes)))
    return rows.join(kept.select(*partition, "_segment"), [*partition, "_segment"], "left_semi").drop("_segment")


def compact(log: DataFrame, key: list[str], order: list[str], tombstone: Column) -> DataFrame:
    """The newest row of each key; keys whose newest row is a tombstone go. Offsets stay as they were."""
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return newest.where(~tombstone)


def truncate(log: DataFrame, offset: int) -> DataFrame:
    return log.where(F.col("offset") < offset)


def compaction_stats(log: DataFrame, key: list[str]) -> DataFrame:
    """Rows in all, rows a compaction would drop, and their ratio."""
    n = log.groupBy(*key).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("compactable")).withColumn("ratio", F.col("compactable") / F.col("total"))


class Snapshots:
    """Copies of a log below a folder, one directory each, with a table of what there is."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def create(self, name: str, log: DataFrame) -> str:
        if self._fs.exists(self._path(f"{self.root}/{name}")):
            raise ValueError(f"snapshot {name} exists")
        log.write.parquet(f"{self.root}/{name}")
        return f"{self.root}/{name}"

    def restore(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def list(self) -> DataFrame:
        """name, created_ms, bytes of each finished snapshot."""
        rows = []
        if self._fs.exists(self._path(self.root)):
            for s in self._fs.listStatus(self._path(self.root)):
                p = s.getPath()
                if self._fs.exists(self._path(f"{p}/_SUCCESS")):
                    rows.append((p.getName(), s.getModificationTime(), self._fs.getContentSummary(p).getLength()))
        return self.spark.createDataFrame(rows, "name string, created_ms long, bytes long")

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def cleanup(self, now_ms: int, keep_ms: int, keep_newest: int) -> list[str]:
        """Deletes snapshots older than keep_ms, then all but the newest; returns their names."""
        names = [r.name for r in surplus(self.list(), now_ms, keep_ms, keep_newest).collect()]
        for name in names:
            self.delete(name)
        return names

    def stats(self) -> DataFrame:
        return snapshot_stats(self.list())


def surplus(snapshots: DataFrame, now_ms: int, keep_ms: int, keep_newest: int) -> DataFrame:
    """Snapshots (name unique, created_ms) older than keep_ms, and all but the newest keep_newest; ties in time go by name.

    The newest are found with a limit that Spark applies in each task first, so no single task orders the table.
    """
    old = F.coalesce(F.col("created_ms") < now_ms - keep_ms, F.lit(False))
    kept = snapshots.orderBy(F.desc("created_ms"), "name").limit(keep_newest).where(~old).select(F.col("name").alias("_name"), F.col("created_ms").alias("_created_ms"))
    return snapshots.join(kept, F.col("name").eqNullSafe(F.col("_name")) & F.col("created_ms").eqNullSafe(F.col("_created_ms")), "left_anti")


def snapshot_stats(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.avg("bytes").alias("mean"), F.min("bytes").alias("smallest"), F.max("bytes").alias("largest"))
