import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import embedding_dedup, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, home boolean, cell int, v string, id long"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((30, 16))
    rows = [base[i % 30] + r.standard_normal(16) * r.choice([0.02, 0.25, 1.0]) for i in range(600)]
    out = [(i, [float(np.float32(x)) for x in v * r.uniform(0.5, 2)]) for i, v in enumerate(rows)]
    out += [(700, None), (701, []), (702, [0.0] * 16), (703, [float("nan")] * 16), (704, [None] * 16), (705, [1.0, 2.0]), (706, [2.0, 4.0]), (707, out[3][1]), (708, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(i, v, 0, True, 1, "x", 5) for i, v in [*out, out[5]]], SCHEMA)
    return df, out


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("slice_rows", [8192, 64])
def test_range_join_is_exact(vectors, space, slice_rows):
    df, rows = vectors
    good = [(i, np.array(v)) for i, v in rows if usable(v)]
    low, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (a, x) in enumerate(good):
        for b, y in good[k + 1 :]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.95:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                low[q] = p
    got = embedding_dedup.near_duplicate_vectors(df, space, 0.95, slice_rows=slice_rows, most_pivots=12).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], root(i), root(i) == i) for i, _ in rows}


def test_replication_bounds_lose_nothing():
    r = np.random.default_rng(1)
    x = embedding_dedup.unit(r.standard_normal((800, 4)))
    pivots, eps = x[:9], 0.3
    row, cell, home = embedding_dedup.cells_of(x, pivots, eps)
    where = {(a, b) for a, b in zip(row.tolist(), cell.tolist())}
    own = dict(zip(row[home].tolist(), cell[home].tolist()))
    near = np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= eps)
    assert len(where) < 800 * 9 and all((b, own[a]) in where for a, b in near.tolist())


def exact(rows, k):
    good = [(i, np.array(v)) for i, v in rows if usable(v)]
    out = {}
    for a, x in good:
        if a % 20 == 0:
            near = sorted((-float(x @ y), b) for b, y in good if b != a and len(y) == len(x))
            out[a] = [b for _, b in near[:k]]
    return out


def test_fewer_candidates_than_asked_for_are_all_found(vectors, space):
    df, rows = vectors
    rows = rows[:20]
    got = {}
    for r in nearest_neighbours.search(df.where(F.col("vec_id").isin([i for i, _ in rows])), F.col("id") % 20 == 0, space, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(rows, 20)


def test_multiprobe_recall(vectors, space):
    df, rows = vectors
    got = {}
    for r in nearest_neighbours.search(df, F.col("id") % 20 == 0, space, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    true = exact(rows, 20)
    assert all(len(got[q]) == len(v) for q, v in true.items())
    assert sum(len(got[q] & set(v)) for q, v in true.items()) >= 0.9 * sum(map(len, true.values()))


@pytest.mark.parametrize("n", [500, 50_000, 500_000, 5_000_000, 10**9])
def test_probes_reach_the_target_at_any_size(n):
    """Spread-out vectors, whatever size the table is said to have: every query has cells of its own, and not all."""
    x = np.random.default_rng(4).standard_normal((600, 64))
    h = nearest_neighbours.Hashing(64, float(np.linalg.norm(x, axis=1).max()), n, x, 20, 2, 0.84)
    assert all(0 < len(c) < (2 * h.reach + 1) ** h.depth <= nearest_neighbours.GRID for c in h.probes(x[:20], 1))


def test_no_vectors(vectors, space):
    df, _ = vectors
    assert nearest_neighbours.search(df.limit(0), F.lit(True), space).count() == 0
    assert embedding_dedup.near_duplicate_vectors(df.limit(0), space).count() == 0
