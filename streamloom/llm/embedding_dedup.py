"""Exact near-duplicate vectors: a metric range join over pivot cells.

On unit vectors cosine >= t is distance <= eps = sqrt(2 - 2t).  Pivots (farthest-first from a bounded sample of
`SAMPLE` rows; the choice affects speed only) partition all vectors: each is at home in the cell of its nearest pivot.
A vector y within eps of an x at home with pivot p obeys d(y,p) - d(y,q) <= 2 eps for y's own pivot q (triangle
inequality), and lies within eps of the bisecting plane of p and q; y is replicated to exactly the cells where both
bounds allow it.  So every link of x is found in x's home cell, and cells join independently.

A cell of more than `SLICE` rows is cut into slices; home slice i meets member slice j in a task of its own, so no
task holds more than about two slices, however hot a cell.  A task counts links and sends, instead of pairs, the
smallest vec_id reachable inside the task, one row a vector; connected components of these rows equal those of all
links.  Products are screened in single precision and decided in double precision where within the rounding margin.

Cost: on vectors spread evenly over many dimensions (eps wide against the spread) the bounds exclude little and the
join nears all pairs in blocks; on clustered vectors cells stay small.

Cases: null, empty, zero and non-finite vectors, or such with null components, link with nothing and are their own
component; vectors of different length do not link; repeated vec_ids count once; rows without a vec_id
are left out; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import Workspace, connected_components
from ._columnar import lean
from ._vectors import by_length, matrix, vectors

SAMPLE = 2048
SLICE = 8192
MOST_PIVOTS = 4096


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(rows: list, n: int, cell_rows: int, most: int) -> dict[int, np.ndarray]:
    """Pivots by vector length."""
    out = {}
    sizes = {len(r.v) for r in rows}
    for d in sizes:
        x = unit(np.array([r.v for r in rows if len(r.v) == d], np.float64))
        want = min(most, len(x), max(1, math.ceil(n / cell_rows)))
        picked, far = [0], np.sqrt(np.maximum(2 - 2 * x @ x[0], 0))
        while len(picked) < want:
            i = int(far.argmax())
            if far[i] <= 1e-9:
                break
            picked.append(i)
            far = np.minimum(far, np.sqrt(np.maximum(2 - 2 * x @ x[i], 0)))
        out[d] = x[picked]
    return out


def cells_of(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) of every placement of unit vectors x."""
    c = np.clip(x @ pivots.T, -1, 1)
    d = np.sqrt(2 - 2 * c)
    home = c.argmax(1)
    at = np.arange(len(x))
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    slack = 1e-7
    triangle = d - d[at, home][:, None] <= 2 * eps + slack
    plane = c[at, home][:, None] - c <= eps * between + slack
    inside = triangle & plane
    inside[at, home] = True
    row, cell = np.nonzero(inside)
    return row, cell, cell == home[row]


def join_slices(home_id: np.ndarray, home: np.ndarray, other_id: np.ndarray, other: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each home vector among the others, and the smallest id reachable from each home and other vector by them."""
    h, o = home.astype(np.float32), other.astype(np.float32)
    margin = 1e-5 + 1e-6 * home.shape[1]
    order_h, order_o = np.argsort(home_id, kind="stable"), np.argsort(other_id, kind="stable")
    h, home, hid = h[order_h], home[order_h], home_id[order_h]
    o, other, oid = o[order_o], other[order_o], other_id[order_o]
    mask = np.zeros((len(h), len(o)), bool)
    for a in range(0, len(h), 1024):
        s = h[a : a + 1024] @ o.T
        m = s >= threshold + margin
        i, j = np.nonzero((s >= threshold - margin) & ~m)
        for k in range(0, len(i), 65536):
            p, q = i[k : k + 65536], j[k : k + 65536]
            m[p, q] = (home[a + p] * other[q]).sum(1) >= threshold
        mask[a : a + 1024] = m
    at = np.searchsorted(oid, hid)
    both = np.flatnonzero((at < len(oid)) & (oid[np.minimum(at, len(oid) - 1)] == hid)) if len(oid) else np.zeros(0, np.int64)
    mask[both, at[both]] = False
    count = mask.sum(1)
    rows, cols = np.flatnonzero(count), np.flatnonzero(mask.any(0))
    sub = mask[np.ix_(rows, cols)]
    lab_h, lab_o = hid.copy(), oid.copy()
    top = np.iinfo(np.int64).max
    while len(rows):
        before = lab_h[rows].copy(), lab_o[cols].copy()
        for a in range(0, len(rows), 512):
            r = rows[a : a + 512]
            lab_h[r] = np.minimum(lab_h[r], np.where(sub[a : a + 512], lab_o[cols][None, :], top).min(1))
        for a in range(0, len(cols), 512):
            c = cols[a : a + 512]
            lab_o[c] = np.minimum(lab_o[c], np.where(sub[:, a : a + 512], lab_h[rows][:, None], top).min(0))
        same = np.minimum(lab_h[both], lab_o[at[both]])
        lab_h[both] = lab_o[at[both]] = same
        if (lab_h[rows] == before[0]).all() and (lab_o[cols] == before[1]).all():
            break
    out_n, out_h, out_o = np.empty(len(hid), np.int64), np.empty(len(hid), np.int64), np.empty(len(oid), np.int64)
    out_n[order_h], out_h[order_h], out_o[order_o] = count, lab_h, lab_o
    return out_n, out_h, out_o


def near_duplicate_vectors(df: DataFrame, space: Workspace, threshold: float = 0.95, key: str = "vec_id", column: str = "embedding", slice_rows: int = SLICE, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row's id."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = space.write(vectors(df, key, column), "vectors")
    n = rows.count()
    most = min(most_pivots, math.ceil(n / slice_rows))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, 4 * most)).collect()
    pivots = choose_pivots(sample, n, slice_rows, most_pivots)
    kind = rows.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column(1)):
                for a in range(0, len(at), 2048):
                    own = at[a : a + 2048]
                    if d in pivots:
                        row, cell, home = cells_of(unit(x[a : a + 2048]), pivots[d], eps)
                    else:  # a length that the sample has not seen: one cell, cut into slices as any other
                        row, cell, home = np.arange(len(own)), np.full(len(own), -1), np.ones(len(own), bool)
                    take = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home), batch.column(0).take(take), batch.column(1).take(take)], ["dim", "cell", "home", "id", "v"])

    placed = rows.mapInArrow(lean(place), f"dim int, cell int, home boolean, id long, v {kind}")
    placed = space.write(placed, "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count_if("home") / slice_rows).cast("int").alias("hs"), F.ceil(F.count("*") / slice_rows).cast("int").alias("ms"))
    known = placed.join(sizes.where("hs > 0"), ["dim", "cell"])
    part = F.xxhash64("id")
    as_home = known.where("home").select("dim", "cell", F.pmod(part, F.col("hs")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("j"), F.lit(True).alias("home"), "id", "v")
    as_member = known.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("i"), F.pmod(part, F.col("ms")).cast("int").alias("j"), F.lit(False).alias("home"), "id", "v")

    def join(table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("home"))
        ids, x = np.asarray(table.column("id")), unit(matrix(table.column("v")))
        n, near, far = join_slices(ids[home], x[home], ids[~home], x[~home], threshold)
        linked = far < ids[~home]
        return pa.table({"id": np.concatenate([ids[home], ids[~home][linked]]), "n": np.concatenate([n, np.zeros(linked.sum(), np.int64)]), "low": np.concatenate([near, far[linked]])})

    met = as_home.union(as_member).groupBy("dim", "cell", "i", "j").applyInArrow(join, "id long, n long, low long")
    met = space.write(met, "met")
    groups = connected_components(met.select(F.col("id").alias("a"), F.col("low").alias("b")), space)
    counts = met.groupBy("id").agg(F.sum("n").alias("n"))
    own = F.col(key).cast("long")
    out = df.where(own.isNotNull()).select(own.alias("id")).distinct().join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))
