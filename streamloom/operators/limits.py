"""Token buckets and adaptive limits over request logs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import micros


def refill(tokens: int, last_us: int, now_us: int, rate: int, window_us: int, most: int) -> tuple[int, int]:
    """Tokens and refill time at now: whole tokens only, and the clock moves only when one came."""
    add = (now_us - last_us) * rate // window_us
    return (min(tokens + add, most), now_us) if add > 0 else (tokens, last_us)


def token_bucket(requests: DataFrame, key: str, ts: str, rate: int, window: timedelta, amount: str | None = None, order: list[str] | None = None) -> DataFrame:
    """requests with `allowed` and `tokens_left`: each key's bucket starts full, refills `rate` in a window, holds `rate`.

    A request depends on all before it of its key, so keys are walked in order within sorted partitions; only the
    current key's two numbers are held, whatever a key's length.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    size = micros(window)
    order = order or [ts]
    rows = requests.repartition(key).sortWithinPartitions(key, *order)
    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("tokens_left", T.LongType())])

    def run(batches):
        current, tokens, last = object(), 0, 0
        for pdf in batches:
            at = pd.to_datetime(pdf[ts]).to_numpy("datetime64[us]").astype(np.int64).tolist()
            n = pdf[amount].tolist() if amount else [1] * len(pdf)
            allowed, left = [], []
            for k, t, wanted in zip(pdf[key].tolist(), at, n):
                if k != current:
                    current, tokens, last = k, rate, t
                tokens, last = refill(tokens, last, t, rate, size, rate)
                ok = tokens >= wanted
                if ok:
                    tokens -= wanted
                allowed.append(ok)
                left.append(tokens)
            yield pdf.assign(allowed=np.array(allowed, bool), tokens_left=np.array(left, np.int64))

    return rows.mapInPandas(run, schema)


def adapt(rate: Column, requests: Column, errors: Column, threshold: float, low: int, high: int) -> Column:
    """The next rate: 0.8 of it when errors exceed the threshold, 1.2 of it when below half of it, within [low, high]."""
    share = F.when(requests > 0, errors / requests).otherwise(F.lit(0.0))
    down = F.greatest(F.floor(rate * 0.8), F.lit(low))
    up = F.least(F.floor(rate * 1.2), F.lit(high))
    return F.when(share > threshold, down).when(share < threshold / 2, up).otherwise(rate).cast("long")


def adaptive_rates(counts: DataFrame, keys: list[str], order: list[str], base: int, threshold: float, low: int, high: int) -> DataFrame:
    """`rate` in force after each interval (requests, errors) of a key, one adjustment an interval.

    A rate depends on the one before: keys are walked in order within sorted partitions, one number held.
    """
    import math

    from pyspark.sql import types as T

    rows = counts.select(*keys, *order, "requests", "errors").repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*[rows.schema[c] for c in (*keys, *order)], T.StructField("rate", T.LongType())])

    def run(batches):
        current, rate = None, base
        for pdf in batches:
            out = []
            for k, q, e in zip(pdf[keys].itertuples(index=False, name=None), pdf["requests"].tolist(), pdf["errors"].tolist()):
                if k != current:
                    current, rate = k, base
                share = e / q if q > 0 else 0.0
                if share > threshold:
                    rate = max(math.floor(rate * 0.8), low)
                elif share < threshold / 2:
                    rate = min(math.floor(rate * 1.2), high)
                out.append(rate)
            yield pdf[[*keys, *order]].assign(rate=out)

    return rows.mapInPandas(run, schema)
