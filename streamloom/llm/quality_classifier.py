"""Quality classifier: a linear SVM on n-gram indicators scaled by naive Bayes log-count ratios.

Features are the byte n-grams (2 to 4) a text has, hashed to `DIMENSIONS`; each is present or not.  Its value is the
class log-count ratio r = log(p/|p|) - log(q/|q|) (counts smoothed by 1), the row is scaled to unit length, and a
hinge loss with L2 penalty is minimised by dual coordinate descent.  Margins become probabilities by a logistic fit on
a fifth of the sample that the first fit did not see, moved from the sample's class balance to that of all labels.

Bounded fit: at most `ROWS_PER_CLASS` labelled rows a class, those of smallest hash; a row has at most DIMENSIONS
features.  Class totals count all labelled rows.  Every text is scored whole.

Cases: null and empty texts have no features and get the score of the intercept; with labels of one class only the
score is that class's share (1 or 0); without any label it is 0.5; a document labelled twice counts twice; null labels and ids
are ignored in the fit, and a row without a doc_id is scored as any other; rows that share a doc_id or a text are each scored by their
own text; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._columnar import _random_words, lean, text_slices, U64

DIMENSIONS = 1 << 16
SIZES = (2, 3, 4)
ROWS_PER_CLASS = 1500
HASHES = 1 << 31
GRAM = _random_words(907, 8) | U64(1)


class Features:
    """Distinct feature numbers of each document of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        x = data.astype(U64) + U64(1)
        n = len(x)
        self.offsets = offsets
        self.grams = []
        for size in SIZES:
            h = np.zeros(max(0, n - size + 1), U64)
            for j in range(size):
                h += x[j : n - size + 1 + j] * GRAM[j] if n >= size else U64(0)
            h *= GRAM[7]
            self.grams.append((size, (h >> U64(48)).astype(np.uint16)))
        self.flags = np.zeros(DIMENSIONS, bool)

    def __iter__(self) -> Iterator[np.ndarray]:
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            for size, g in self.grams:
                self.flags[g[a : max(a, b - size + 1)]] = True
            found = np.flatnonzero(self.flags)
            self.flags[found] = False
            yield found


@dataclass
class Model:
    weights: np.ndarray  # w * r by feature
    squares: np.ndarray  # r * r by feature
    slope: float
    intercept: float

    def margin(self, found: np.ndarray) -> float:
        norm = self.squares[found].sum()
        return float(self.weights[found].sum() / np.sqrt(norm)) if norm > 0 else 0.0

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.intercept, -50, 50)))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """w of min |w|^2/2 + cost * sum max(0, 1 - y w.x), one dual variable at a time within [0, cost]."""
    w, alpha = np.zeros(DIMENSIONS), np.zeros(len(rows))
    square = np.array([max(float((v * v).sum()), 1e-12) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return w


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.ones(DIMENSIONS), np.ones(DIMENSIONS)
    for found, label in zip(rows, y):
        (p if label > 0 else q)[found] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a weak penalty."""
    x = np.stack([margins, np.ones_like(margins)], 1)
    t, b = (y > 0).astype(float), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - t) + 1e-2 * b
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def train(rows: list[np.ndarray], y: np.ndarray, positive: int, negative: int) -> Model:
    """y: 1 or -1 by row; positive and negative: rows of either class among all labelled ones."""
    if not (y > 0).any() or not (y < 0).any():
        share = 0.5 if not len(y) else float((y > 0).mean())
        return Model(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, float(np.clip(1000 * (share - 0.5), -50, 50)))

    def fit(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [rows[i] for i in index]
        r = ratios(own, y[index])
        values = [r[f] / max(np.sqrt((r[f] ** 2).sum()), 1e-9) for f in own]
        return dual_coordinate_descent(own, values, y[index]) * r, r * r

    seen = np.arange(len(y)) % 5 != 0
    slope, intercept = 4.0, 0.0
    if 0 < (y[~seen] > 0).sum() < (~seen).sum() and 0 < (y[seen] > 0).sum() < seen.sum():
        part = Model(*fit(np.flatnonzero(seen)), 1.0, 0.0)
        held = np.array([part.margin(rows[i]) for i in np.flatnonzero(~seen)])
        slope, intercept = logistic(held, y[~seen])
        t = y[~seen]
        intercept += np.log(positive / negative) - np.log((t > 0).sum() / (t < 0).sum())
    return Model(*fit(np.arange(len(y))), slope, float(intercept))


def feature_lists(docs: DataFrame) -> DataFrame:
    """doc_id, features of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([f.astype(np.int32) for f in Features(data, offsets)], pa.list_(pa.int32()))], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Learns from labels of rows that `allowed` (on doc_id) admits."""
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    known = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)))
    # About twice the wanted rows of each class have a hash below its share: all that are ranked, whatever the table's size.
    low = F.lit(False)
    for y, n in totals.items():
        low = low | ((F.col("y") == y) & (F.col("h") < min(HASHES, -(-HASHES * (2 * rows_per_class + 200) // n))))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))
    chosen = known.where(low).withColumn("r", rank).where(F.col("r") <= rows_per_class).select("doc_id", "y", "r")
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, y int, r int")  # 2 * rows_per_class rows at most
    wanted = F.broadcast(chosen.select("doc_id").distinct())
    texts = feature_lists(docs.join(wanted, "doc_id", "left_semi"))
    rows = sorted(texts.join(F.broadcast(chosen), "doc_id").select("r", "y", "doc_id", "features").collect(), key=lambda r: (r.r, r.y, r.doc_id))
    return train([np.array(r.features, np.int64) for r in rows], np.array([2 * r.y - 1 for r in rows]), totals.get(1, 0), totals.get(0, 0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                margins = np.array([model.margin(f) for f in Features(data, offsets)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.probability(margins))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
