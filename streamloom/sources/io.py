"""Record schemas, readers and writers for logs; batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A durable log row.
MESSAGE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("crc32", T.LongType()),
    ]
)
#: Formats a topic's values can be decoded from at the edge, and how.
FORMATS = ("json", "string", "bytes", "avro", "protobuf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with event time as an instant (streams need one)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same rows as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def read_log(spark: SparkSession, path: str, topics: list[str] | None = None, partitions: list[int] | None = None, streaming: bool = False, **options: str) -> DataFrame:
    """A Parquet log laid out by topic and partition; both prune directories."""
    reader = (spark.readStream if streaming else spark.read).schema(MESSAGE).options(**options)
    df = reader.parquet(path)
    if topics is not None:
        df = df.where(F.col("topic").isin(topics))
    if partitions is not None:
        df = df.where(F.col("partition").isin(partitions))
    return df


def read_kafka(spark: SparkSession, servers: str, topics: list[str], start: str = "earliest", streaming: bool = True, assign: dict[str, list[int]] | None = None, **options: str) -> DataFrame:
    """Needs Spark's Kafka package on the class path; rows get the names of MESSAGE."""
    import json

    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("startingOffsets", start).option("includeHeaders", "true")
    reader = reader.option("assign", json.dumps(assign)) if assign else reader.option("subscribe", ",".join(topics))
    df = reader.options(**options).load()
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return df.select("topic", "partition", "offset", "key", "value", headers.alias("headers"), F.col("timestamp").alias("ts"))


def decode(df: DataFrame, schema: str | T.StructType, fmt: str = "json", value: str = "value") -> DataFrame:
    """Typed columns for the payload, once at the edge; rows that do not parse have nulls and their text in `dead_letter`."""
    if fmt == "string":
        return df.withColumn(value, F.col(value).cast("string"))
    if fmt == "bytes":
        return df
    if fmt != "json":
        raise NotImplementedError(f"{fmt} needs Spark's package for it on the class path")
    text = F.col(value).cast("string")
    parsed = F.from_json(text, schema)
    bad = F.from_json(text, schema, {"mode": "PERMISSIVE"}).isNull() & text.isNotNull()
    return df.withColumn("_p", parsed).withColumn("dead_letter", F.when(bad, text)).select(*[c for c in df.columns if c != value], "_p.*", "dead_letter")


def encode(df: DataFrame, key: Column | str, fields: list[str]) -> DataFrame:
    """key, value rows for a sink: the fields as JSON."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.cast("string").cast("binary").alias("key"), F.to_json(F.struct(*fields)).cast("binary").alias("value"))


def write_log(df: DataFrame, path: str, mode: str = "append", rows_per_file: int = 0) -> None:
    """Batch append, laid out by topic and partition; rows_per_file rolls files."""
    writer = df.write.mode(mode).partitionBy("topic", "partition")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
