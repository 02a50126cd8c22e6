"""Running values along a key's order, taken block by block, so that one busy key is spread over many tasks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import micros

#: Times are cut into blocks of this length, whole numbers into blocks of this many values.
SPAN = timedelta(days=1)
STEP = 1 << 16


def block_of(df: DataFrame, column: str, span: timedelta = SPAN, step: int = STEP) -> Column:
    """A coarser column that never falls where `column` rises; types other than times, dates and whole numbers are one block."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(micros(span)))
    if isinstance(kind, T.IntegralType):
        return F.floor(F.col(column) / F.lit(step))
    return F.col(column) if isinstance(kind, T.DateType) else F.lit(0)


def running(df: DataFrame, keys: list[str], order: list[str], exclusive: bool = False, block: Column | None = None, **values: tuple[str, Column | None]) -> DataFrame:
    """df with a column for each of `values`: ("count", None), ("sum", x), ("max", x) or ("last", x) over a key's rows up to each row.

    `last` is the last x that is not null; `exclusive` leaves the row itself out.  A key's blocks are summed up first, with
    partial aggregation; what lies before a block enters it as one more row, in front, so rows are dealt by (key, block)
    once and no task sorts a whole key.  Keys may be null.  `block` must rise with `order`.
    """
    block = block_of(df, order[0]) if block is None else block
    rows = df.withColumn("_block", block).withColumn("_side", F.lit(1))
    for name, (kind, x) in values.items():
        rows = rows.withColumn(f"_x_{name}", F.lit(1).cast("long") if kind == "count" else x)
    whole, before = [], W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    for name, (kind, _) in values.items():
        x = F.col(f"_x_{name}")
        at = F.struct(*order)
        whole.append({"count": F.sum(x), "sum": F.sum(x), "max": F.max(x), "last": F.max_by(x, F.when(x.isNotNull(), at))}[kind].alias(f"_x_{name}"))

    def over(kind: str, x: Column, window) -> Column:
        return {"count": F.sum, "sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind](x).over(window)

    blocks = rows.groupBy(*keys, "_block").agg(*whole)
    front = blocks.select(*keys, "_block", F.lit(0).alias("_side"), *[over(k, F.col(f"_x_{n}"), before).alias(f"_x_{n}") for n, (k, _) in values.items()])
    both = rows.unionByName(front, allowMissingColumns=True)
    window = W.partitionBy(*keys, "_block").orderBy("_side", *order).rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    for n, (k, _) in values.items():
        value = over(k, F.col(f"_x_{n}"), window)
        both = both.withColumn(n, F.coalesce(value, F.lit(0)).cast("long") if k == "count" else value)
    return both.where("_side = 1").drop("_block", "_side", *[f"_x_{n}" for n in values])
