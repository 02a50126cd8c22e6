"""Where intermediate tables go, joins whose small side is measured first, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows and bytes of an Arrow batch: texts and lists are long, and a worker holds a batch or two beside its work.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: Rows up to which a two-column side may be broadcast: some tens of MB of hash relation at most.
BROADCAST_ROWS = 100_000
#: Column of row_keyed.
ROW = "_row_of_input"


def prepare(spark: SparkSession) -> SparkSession:
    """Executors get the package; batches to and from Python are bounded; a job's shuffle files go with the job; sorted buckets are read as such."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return ship_package(spark)


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; where the session names none, one under /tmp if driver and executors are one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "/tmp/checkpoints"
    return root.rstrip("/")


class Workspace:
    """Named Parquet tables of one query below the shared folder: written once, read again, kept until dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = prepare(spark)
        self.path = f"{shared_folder(spark)}/streamloom/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Cuts the lineage: a lost executor costs a re-read, not a recomputation."""
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write_dealt(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """As `write`, but bucketed and sorted by `keys`: joins and groups on them move none of its rows.

        For rows that are dealt by `keys` already (grouped or joined by them, or repartitioned), one row or few a key; there are as
        many buckets as shuffle partitions.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"streamloom_{uuid.uuid4().hex}"
        df.write.bucketBy(n, *keys).sortBy(*keys).option("compression", "zstd").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, items: str | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks `df` (a written table, narrow rows) for broadcast if it is counted to have few rows, and few `items` (a list column); else joins shuffle."""
    weight = F.lit(1) if items is None else F.size(items) + 1
    n = df.select(weight.alias("n")).limit(most + 1).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(df) if n <= most else df


def row_keyed(docs: DataFrame, space: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with ROW, a key of each row in the order of `key` (nulls last, then by text), to join on.

    It is `key` itself where no row lacks it and none repeats it; else the rows are sorted, numbered and written once.
    """
    odd = docs.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("k is null or n > 1")
    if not odd.limit(1).count():
        return docs.withColumn(ROW, F.col(key))
    placed = docs.withColumn(ROW, F.monotonically_increasing_id()).orderBy(F.col(key).asc_nulls_last(), text, ROW)  # ROW parts rows that are alike
    return space.write(placed.withColumn(ROW, F.monotonically_increasing_id()), "rows-keyed")


def connected_components(edges: DataFrame, space: Workspace, name: str = "cc", rounds: int = 40) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node of it.

    edges: columns a, b (long).  Alternating large-star and small-star steps, each a grouped minimum (combined before
    the shuffle) and a join whose right side has one row a node, so that a hub is split by adaptive execution.
    Every step is written to the shared folder; nothing but two numbers reaches the driver.
    """
    now = space.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen = None
    for i in range(1, rounds + 1):
        both = now.union(now.select("b", "a"))
        low = space.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = space.write(large.where("a <> b").distinct(), f"{name}-down")
        least = space.write(down.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        now = space.write(small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct(), f"{name}-{i}")
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if i > 1:
            space.drop(f"{name}-{i - 2}")
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    space.drop(f"{name}-low", f"{name}-down", f"{name}-least", f"{name}-{i - 1}")
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
