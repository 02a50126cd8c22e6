"""Block-wise running values against plain windows over whole keys."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamloom.operators import joins as J
from streamloom.operators.running import block_of, running


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit("hot")).when(i % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 7))
    ts = F.when(i % 101 != 0, F.timestamp_micros(i * 7919 % 5000 * 600_000_000))
    return spark.range(3000).select("id", key.alias("k"), ts.alias("ts"), F.when(i % 4 != 0, i * 31 % 97).alias("x")).cache()


@pytest.mark.parametrize("exclusive", [False, True])
def test_like_a_window_over_the_whole_key(table, exclusive):
    w = W.partitionBy("k").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    x = F.col("x")
    want = table.select("id", F.count("*").over(w).alias("n"), F.sum(x).over(w).alias("s"), F.max(x).over(w).alias("m"), F.last(x, True).over(w).alias("l"))
    got = running(table, ["k"], ["ts", "id"], exclusive, n=("count", None), s=("sum", x), m=("max", x), l=("last", x))
    assert got.columns == [*table.columns, "n", "s", "m", "l"]
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_key_is_dealt_by_blocks_too(table):
    plan = running(table, ["k"], ["ts", "id"], n=("count", None))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(k" in line]
    assert len(dealt) == 3 and sum("_block" in line for line in dealt) == 2  # rows, block sums; the window over block sums


def test_blocks_rise_with_the_order(spark):
    df = spark.range(-3, 200000, 997).withColumn("t", F.timestamp_micros(F.col("id") * 10**7)).withColumn("s", F.col("id").cast("string"))
    for c in ("id", "t"):
        got = [r[0] for r in df.orderBy(c).select(block_of(df, c)).collect()]
        assert got == sorted(got) and len(set(got)) > 3
    assert df.select(block_of(df, "s")).distinct().count() == 1


def test_empty_table(table):
    assert running(table.where("false"), ["k"], ["ts"], n=("count", None)).count() == 0


def test_as_of_takes_the_last_known_value_across_days(spark):
    r = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-05", None), ("b", "2024-01-02", 2.0)], "k string, d string, value double").select("k", F.col("d").cast("timestamp").alias("ts"), "value")
    l = spark.createDataFrame([(1, "a", "2023-12-31"), (2, "a", "2024-01-01"), (3, "a", "2024-02-01"), (4, "c", "2024-01-01")], "id int, k string, d string").select("id", "k", F.col("d").cast("timestamp").alias("ts"))
    assert sorted((x.id, x.as_of) for x in J.as_of_join(l, r, "k").collect()) == [(1, None), (2, 1.0), (3, 1.0), (4, None)]
