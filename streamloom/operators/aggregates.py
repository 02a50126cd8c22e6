"""Aggregate expressions: the usual ones, first and last by event time, ordered folds, and grouped application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import Session, Window


def first_by(value: str, *order: str) -> Column:
    """The value of the earliest row by `order` (deterministic, unlike an arrival-order first)."""
    return F.min_by(value, F.struct(*order))


def last_by(value: str, *order: str) -> Column:
    return F.max_by(value, F.struct(*order))


def fold(value: str, order: list[str], zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    """Values of a group folded in `order`: a custom binary reduction; holds a group's values at once."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    values = F.transform(rows, lambda r: r["_v"])
    return F.aggregate(values, zero, step, finish) if finish else F.aggregate(values, zero, step)


def named(function: str, value: str | None = None, order: tuple[str, ...] = ("ts",)) -> Column:
    """count sum avg min max first last."""
    if function == "count":
        return F.count(F.lit(1))
    if value is None:
        raise ValueError(f"{function} needs a value column")
    simple = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if function in simple:
        return simple[function](value)
    if function in ("first", "last"):
        return (first_by if function == "first" else last_by)(value, *order)
    raise ValueError(f"unknown aggregate {function}")


def windowed(df: DataFrame, window: Window, keys: list[str], ts: str, **aggregates: Column) -> DataFrame:
    """keys, window_start, window_end (absent for a global window) and the aggregates.

    Partial aggregation happens before the shuffle.  A session's end is its last row's time.
    """
    column = window.column(F.col(ts))
    cols = [a.alias(n) for n, a in aggregates.items()]
    if column is None:
        return df.groupBy(*keys).agg(*cols)
    if isinstance(window, Session):
        out = df.groupBy(*keys, column.alias("_w")).agg(F.max(ts).alias("window_end"), *cols)
        return out.select(*keys, F.col("_w.start").alias("window_start"), "window_end", *aggregates)
    out = df.groupBy(*keys, column.alias("_w")).agg(*cols)
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggregates)
