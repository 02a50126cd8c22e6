"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Inner product becomes distance by one more coordinate: candidates get sqrt(M^2 - |x|^2) (M: the largest norm), queries
are scaled to norm M and get 0; everything is divided by M.  Each of `TABLES` tables hashes a vector to the cell
floor((a.x + b) / W) in k Gaussian directions.  For a neighbour at distance r the difference in a direction is
N(0, r^2), so each cell around a query has a known success probability; a query visits cells in falling order of it
until their sum reaches the per-table target.  Candidates of all tables are merged and ranked by the exact product.

Fitted on a bounded sample (`SAMPLE` rows): r, the distance within which the sought neighbours of 9 in 10 sampled
queries lie.  The number of directions grows with the table as far as the grid of cells within `SPREAD` r of a query stays
within `GRID` cells; that grid is enumerated whole, and its probabilities sum to more than the target, so every query is answered
by its probes at any size.  Every row is indexed.  Cells are dealt to shards of about `SHARD` rows by hash; a shard with more is cut
by vec_id hash and its queries go to all its parts, so a hot cell does not grow a task.  Only the best `k` of a query
leave a task.  A query whose cells hold fewer than k vectors is run again over all cells, which is the exact answer.

Cases: null, empty, zero and non-finite vectors take no part; a query is not its own candidate; ties go to the smaller
id; with fewer than k candidates all are returned; only candidates of the query's own length count; repeated ids count once,
rows without one take no part; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import Workspace
from ._columnar import lean
from ._vectors import by_length, matrix, vectors

TABLES = 2
TARGET = 0.84
SAMPLE = 4096
SHARD = 8192
#: Cells of the grid around a query, and how far it reaches, in distances r.
GRID, SPREAD = 65_536, 3.0


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26 by way of erf; error below 2e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    e = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return 0.5 * (1 + np.sign(x) * e)


class Hashing:
    """Tables for vectors of one length."""

    def __init__(self, dim: int, norm: float, n: int, sample: np.ndarray, k: int, tables: int, target: float, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        self.norm, self.tables, self.target = norm, tables, target
        self.width = 1.0
        self.radius = self._radius(sample, n, k)
        self.reach = math.ceil(SPREAD * self.radius / self.width)
        wanted = int(np.clip(round(math.log(max(n, 2) / 64) / math.log(5)), 2, 8))
        self.depth = max(1, min(wanted, int(math.log(GRID) / math.log(2 * self.reach + 1))))
        self.a = rng.standard_normal((tables, dim + 1, self.depth))
        self.b = rng.random((tables, self.depth)) * self.width

    def _radius(self, sample: np.ndarray, n: int, k: int) -> float:
        q, x = self.lift(sample[:256], True), self.lift(sample, False)
        d = 2 - 2 * np.clip(q @ x.T, -1, 1)
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        rank = min(max(1, round(k * len(x) / max(n, 1))), len(x) - 1)
        if rank < 1:
            return 1.0
        return math.sqrt(max(float(np.quantile(np.sort(d, 1)[:, rank - 1], 0.9)), 1e-4))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            return np.concatenate([x, np.zeros((len(x), 1))], 1)
        x = x / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))], 1)

    def slots(self, x: np.ndarray, t: int) -> np.ndarray:
        return (x @ self.a[t] + self.b[t]) / self.width

    @staticmethod
    def code(slots: np.ndarray) -> np.ndarray:
        """Cells as numbers: 8 bits a direction, slots from -128 to 127 (40 spreads of the data away)."""
        out = np.zeros(slots.shape[:-1], np.int64)
        for i in range(slots.shape[-1]):
            out = out << 8 | np.clip(slots[..., i] + 128, 0, 255).astype(np.int64)
        return out

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.code(np.floor(self.slots(self.lift(x, False), t)))

    def probes(self, q: np.ndarray, t: int) -> list[np.ndarray]:
        """Cells in falling order of success probability, up to the target."""
        f = self.slots(self.lift(q, True), t)
        steps = np.arange(-self.reach, self.reach + 1)
        edge = np.floor(f)[:, :, None] + steps
        s = self.width / self.radius
        p = normal_cdf((edge + 1 - f[:, :, None]) * s) - normal_cdf((edge - f[:, :, None]) * s)
        grid = np.indices((len(steps),) * self.depth).reshape(self.depth, -1)
        out = []
        for i in range(len(q)):
            mass = np.ones(1)
            for j in range(self.depth):
                mass = np.multiply.outer(mass, p[i, j]).ravel()
            order = np.argsort(-mass, kind="stable")
            order = order[: int(np.searchsorted(np.cumsum(mass[order]), self.target)) + 1]
            out.append(self.code(np.stack([edge[i, j][grid[j, order]] for j in range(self.depth)], 1)))
        return out


def shard_of(cells: np.ndarray, shards: int) -> np.ndarray:
    x = cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def search(df: DataFrame, is_query: Column, space: Workspace, k: int = 20, key: str = "vec_id", column: str = "embedding", tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score; `is_query` is a condition on the column id."""
    spark = df.sparkSession
    rows = space.write(vectors(df, key, column), "vectors")
    norms = rows.select(F.size("v").alias("d"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("n"))
    stats = {r.d: (r.n, r.m) for r in norms.groupBy("d").agg(F.count("*").alias("n"), F.max("n").alias("m")).collect()}
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    hashing = {}
    for d, (n, norm) in stats.items():
        own = [r.v for r in sample if len(r.v) == d]
        hashing[d] = Hashing(d, norm, n, np.array(own, np.float64).reshape(len(own), d), k, tables, target)
    shards = {d: max(1, math.ceil(n / SHARD)) for d, (n, _) in stats.items()}
    kind = rows.schema["v"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column(1)):
                h, own = hashing[d], batch.take(pa.array(at))
                for t in range(h.tables):
                    cells = h.cells(x, t)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d * 16 + t, np.int32)), pa.array(shard_of(cells, shards[d])), pa.array(cells), own.column(0), own.column(1)], ["t", "shard", "cell", "id", "v"])

    def route(everywhere: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, at, x in by_length(batch.column(1)):
                    h = hashing[d]
                    for t in range(1 if everywhere else h.tables):
                        found = [np.zeros(0, np.int64)] * len(at) if everywhere else h.probes(x, t)
                        row, shard, probes = [], [], []
                        for i, cells in enumerate(found):
                            if not len(cells):
                                row += [at[i]] * shards[d]
                                shard += range(shards[d])
                                probes += [[]] * shards[d]
                                continue
                            of = shard_of(cells, shards[d])
                            for s in np.unique(of):
                                row.append(at[i])
                                shard.append(s)
                                probes.append(cells[of == s])
                        take = pa.array(row, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d * 16 + t, np.int32)), pa.array(shard, pa.int32()), pa.array(probes, pa.list_(pa.int64())), batch.column(0).take(take), batch.column(1).take(take)], ["t", "shard", "probes", "id", "v"])

        return run

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        cell, ids, x = np.asarray(left.column("cell")), np.asarray(left.column("id")), matrix(left.column("v"))
        by = np.argsort(cell, kind="stable")
        cell, ids, x = cell[by], ids[by], x[by]
        qid, q = np.asarray(right.column("id")), matrix(right.column("v"))
        probes = right.column("probes").combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(probes))
        wanted, asker = np.asarray(probes.flatten()), np.repeat(np.arange(len(qid)), sizes)
        there = np.unique(cell)
        for i in np.flatnonzero(sizes == 0):
            wanted, asker = np.concatenate([wanted, there]), np.concatenate([asker, np.full(len(there), i)])
        order = np.argsort(wanted, kind="stable")
        wanted, asker = wanted[order], asker[order]
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def best() -> tuple[np.ndarray, ...]:
            a, v, s = (np.concatenate(z) for z in zip(*found))
            o = np.lexsort((v, -s, a))
            a, v, s = a[o], v[o], s[o]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < k
            return a[keep], v[keep], s[keep]

        for c in there:
            a, b = np.searchsorted(cell, [c, c + 1])
            p, r = np.searchsorted(wanted, [c, c + 1])
            for i in range(p, r, 1024):
                who = asker[i : min(r, i + 1024)]
                s = q[who] @ x[a:b].T
                s[qid[who][:, None] == ids[a:b][None, :]] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k][:, None] if b - a > k else -np.inf
                i1, i2 = np.nonzero((s >= least) & (s > -np.inf))
                found.append((who[i1], ids[a:b][i2], s[i1, i2]))
                held += len(i1)
                if held > 2_000_000:
                    found[:] = [best()]
                    held = len(found[0][0])
        if not found:
            return none
        a, v, s = best()
        return pa.table({"query_id": qid[a], "vec_id": v, "score": s})

    schema = f"t int, shard int, cell long, id long, v {kind}"
    if not stats:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    cells = space.write(rows.mapInArrow(lean(index), schema), "index")
    parts = cells.groupBy("t", "shard").agg(F.ceil(F.count("*") / (2 * SHARD)).cast("int").alias("parts"))
    parts = space.write(parts, "parts")
    dealt = cells.join(parts, ["t", "shard"]).select("t", "shard", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "cell", "id", "v")

    def run(queries: DataFrame, everywhere: bool) -> DataFrame:
        routed = queries.mapInArrow(lean(route(everywhere)), f"t int, shard int, probes array<long>, id long, v {kind}")
        known = spark.read.schema(parts.schema).parquet(f"{space.path}/parts")  # a reading of its own: both sides join it
        routed = routed.join(known, ["t", "shard"]).select("t", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "probes", "id", "v")
        return dealt.groupBy("t", "shard", "part").cogroup(routed.groupBy("t", "shard", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")

    queries = rows.where(is_query)
    found = space.write(run(queries, False), "found")
    distinct = F.count_distinct("vec_id")
    short = queries.join(found.groupBy("query_id").agg(distinct.alias("n")).where(F.col("n") >= k), F.col("id") == F.col("query_id"), "left_anti")
    short = space.write(short, "short")
    if short.head(1):
        found = found.union(space.write(run(short, True), "found-all"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
