"""Vector columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Not null, not empty, every component finite, not the zero vector."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v) of usable rows; rows that repeat an id count once (the smallest vector)."""
    rows = df.where(F.col(key).isNotNull() & usable(column)).select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def by_length(column: pa.Array):
    """(row numbers, matrix) for each vector length in a batch."""
    sizes = np.asarray(pa.compute.list_value_length(column))
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, matrix(column.take(pa.array(rows)))
