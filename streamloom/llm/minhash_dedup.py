"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is the weighted set of its five-word shingles, a shingle weighing as often as it occurs, and similarity is
the weighted Jaccard index (sum of minima over sum of maxima; the plain one where no shingle repeats).

Signature: each shingle owns a plane of weight x rank on which darts fall as a Poisson process, hashed from the
shingle alone, so that all documents see the same darts.  The weight axis is cut into dyadic regions [0,1), [1,2),
[2,4), ...; a document of total weight X throws the darts of the regions its weights reach, up to rank
COORDINATES * (ln COORDINATES + 3) / X, keeps those below its weights, and each dart names one coordinate.  The
earliest dart a coordinate keeps is its hash: two documents agree on it with probability equal to their similarity.  The
few coordinates still empty are filled by throwing further.  Cost: the shingles plus a fixed number of darts.

Join: `BANDS` bands of `ROWS` coordinates; documents that share a band are candidates (a pair at 0.8 is missed with
probability 7e-5).  Exact copies are folded into one representative first.  In each band's bucket all are verified
against its smallest member; components follow; only pairs of one bucket that lie in different components remain, and
those are compared block against block inside tasks, without becoming rows.  So every candidate pair is either verified
or already joined: none is given up.  Verification compares whole shingle multisets.

Cases: null texts and texts without words are in no group and are kept; 1 to 4 words make one shingle; the smallest
doc_id of a group is kept; an empty table gives an empty result; extra columns are not touched.  Rows without a doc_id are left
out, and rows that share one are one document, near to whatever any of its texts is near to: a caller whose ids are not
unique passes a row key (row_keyed), as the pipeline does.  Very long texts: signatures cost the shingles of a text; two texts
are compared as sorted lists of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import Workspace, broadcast_if_small, connected_components
from ._columnar import _random_words, lean, mix, Polynomial, ragged, signed, text_slices, U64, Words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Shingles of the documents of one block, on average, when a bucket's components are compared.
BLOCK_ITEMS = 500_000
WORD = Polynomial(601)
FACTORS = _random_words(701, 16) | U64(1)
BAND_FACTORS = _random_words(733, 16) | U64(1)
STEP = U64(0x9E3779B97F4A7C15)


def _times(n: int) -> np.uint64:
    return U64(n * int(STEP) & 0xFFFFFFFFFFFFFFFF)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle and its document; documents of fewer words have one shingle, those of none have none."""
    h = WORD.of_bytes(words.data, words.starts, words.ends)
    n = len(h)
    start = np.zeros(0, np.int64)
    if n >= size:
        start = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
    out = np.zeros(len(start), U64)
    for j in range(size):
        out += h[start + j] * FACTORS[j]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    one = np.zeros(len(short), U64)
    for j in range(size - 1):
        has = words.counts[short] > j
        one[has] += h[words.first[short[has]] + j] * FACTORS[j]
    one += words.counts[short].astype(U64)
    return mix(np.concatenate([out, one])), np.concatenate([words.doc[start], short])


def weighted(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with the number of times it occurs, by document."""
    by = np.lexsort((hashes, doc))
    h, d = hashes[by], doc[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def dart_signatures(hashes: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """Signature (documents x k) of weighted sets; rows of empty sets are 0."""
    total = np.bincount(doc, weight, n_docs)
    sig = np.zeros((n_docs, k), U64)
    todo = total > 0
    limit = np.divide(k * (math.log(k) + 3), total, out=np.zeros(n_docs), where=todo)
    while todo.any():
        own = todo[doc]
        h, d, w = hashes[own], doc[own], weight[own]
        best = np.full(n_docs * k, np.inf)
        thrown: list[tuple[np.ndarray, ...]] = []
        low, high = 0, 1
        while True:  # one dyadic region of the weight axis after the other
            reach = w > low
            if not reach.any():
                break
            seed = mix(h[reach] + _times(high))
            dd, ww, end = d[reach], w[reach], limit[d[reach]]
            rank, i = np.zeros(len(dd)), 0
            while len(seed):
                i += 1
                x = mix(seed + _times(i))
                rank = rank - np.log(((x >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / (high - low)
                on = rank < end
                if not on.all():
                    seed, dd, ww, end, rank, x = seed[on], dd[on], ww[on], end[on], rank[on], x[on]
                y = mix(x + STEP)
                hit = slice(None)
                if high > 1:
                    hit = low + (y >> U64(40)).astype(np.float64) * 2.0**-24 * (high - low) <= ww
                slot = dd[hit] * k + ((y[hit] & U64(0xFFFFFFFF)) * U64(k) >> U64(32)).astype(np.int64)
                np.minimum.at(best, slot, rank[hit])
                thrown.append((slot, rank[hit], y[hit]))
            low, high = high, 2 * high
        flat = sig.reshape(-1)
        for slot, rank, y in thrown:
            won = best[slot] == rank
            flat[slot[won]] = y[won]
        full = np.isfinite(best.reshape(n_docs, k)).all(1)
        todo &= ~full
        limit = limit * 2
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    out = np.empty((len(sig), bands), U64)
    for b in range(bands):
        x = np.full(len(sig), _times(b + 1))
        for j in range(rows):
            x += sig[:, b * rows + j] * BAND_FACTORS[j]
        out[:, b] = mix(x)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the text), weight (total of its shingles) and band keys of documents that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                h, d, w = weighted(*shingles(Words(data, offsets)))
                keys = band_keys(dart_signatures(h, d, w, b - a))
                total = np.bincount(d, w, b - a).astype(np.int64)
                has = np.flatnonzero(total)
                pick = pa.array(has)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pick), batch.column(1).slice(a, b - a).take(pick), pa.array(total[has]), pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(signed(keys[has].ravel())))],
                    ["doc_id", "sha", "weight", "bands"],
                )

    rows = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, sha binary, weight long, bands array<long>")


def shingle_lists(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted hashes of (shingle, how many-th occurrence): the weighted set written as a plain one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                h, d, w = weighted(*shingles(Words(data, offsets)))
                nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                x, d = np.repeat(h, w), np.repeat(d, w)
                x = np.where(nth == 0, x, mix(x + nth.astype(U64) * STEP))
                by = np.lexsort((signed(x), d))
                cut = np.searchsorted(d, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed(x)[by]))], ["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, items array<long>")


def verified(pairs: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose similarity reaches the threshold."""
    both = pairs.join(lists.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(lists.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, xo = ragged(batch.column(2))
            y, yo = ragged(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
                at = np.searchsorted(p, q)
                same = int((p[np.minimum(at, len(p) - 1)] == q).sum()) if len(p) else 0
                ok[i] = same >= threshold * (len(p) + len(q) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def across(rows: DataFrame, distinct: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components c of one bucket: rows are (band, key, doc_id, c, blocks).

    A bucket is cut into blocks of about BLOCK_ITEMS shingles; each pair of blocks is one task's work, which counts the common shingles
    of one document with all of the other block at once and sends a link only where it joins two components.  A
    pair that shares several bands is looked at in the first of them.
    """
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    placed = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "c")
    full = placed.join(distinct.select("doc_id", "bands"), "doc_id").join(lists, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        band = table.column("band")[0].as_py()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, ids, c = (np.asarray(table.column(n)) for n in ("block", "doc_id", "c"))
        bands = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        items, cut = ragged(table.column("items"))
        size = np.diff(cut)
        right = np.flatnonzero(block == j)
        values, dense = np.unique(items, return_inverse=True)
        pick = np.repeat(cut[right], size[right]) + np.arange(size[right].sum()) - np.repeat(np.cumsum(size[right]) - size[right], size[right])
        theirs, owner = dense[pick], np.repeat(np.arange(len(right)), size[right])
        flag = np.zeros(len(values), bool)
        label = {int(x): int(x) for x in np.unique(c)}

        def root(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        a, b = [], []
        for x in np.flatnonzero(block == i).tolist():
            if (c[right] == c[x]).all():
                continue
            own = dense[cut[x] : cut[x + 1]]
            flag[own] = True
            same = np.bincount(owner, flag[theirs], len(right))
            flag[own] = False
            near = (same >= threshold * (size[x] + size[right] - same)) & (c[right] != c[x])
            for k in np.flatnonzero(near).tolist():
                y = right[k]
                if int((bands[x] == bands[y]).argmax()) != band or root(int(c[x])) == root(int(c[y])):
                    continue
                label[root(int(c[x]))] = root(int(c[y]))
                a.append(ids[x])
                b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("band", "key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, space: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, copy_of (smallest doc_id with the same text), component_id (smallest doc_id of its group), kept; one row a doc_id."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = space.write(signatures(ids), "signatures")
    # Tables of keys that occur more than once are written: joined to them, a hot key's rows can be split over tasks.
    copies = space.write(all_rows.groupBy("sha").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n")).where("n > 1").select("sha", "copy_of"), "copies")
    member = all_rows.join(copies, "sha", "left").select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), "weight", "bands")
    member = space.write(member, "member")
    space.drop("signatures", "copies")
    distinct = member.where("doc_id = copy_of").groupBy("doc_id").agg(F.min(F.struct("weight", "bands")).alias("r")).select("doc_id", "r.*")
    banded = distinct.select("doc_id", "weight", F.posexplode("bands").alias("band", "key"))
    buckets = space.write(banded.groupBy("band", "key").agg(F.min("doc_id").alias("center"), F.count("*").alias("n")).where("n > 1").select("band", "key", "center"), "buckets")
    hits = space.write(banded.join(buckets, ["band", "key"]), "hits")

    involved = space.write(hits.select("doc_id").distinct(), "involved")
    lists = space.write(shingle_lists(ids.join(broadcast_if_small(involved), "doc_id", "left_semi")), "shingles")
    centers = hits.where("doc_id = center").select("band", "key", F.col("weight").alias("wa"))
    stars = hits.where("doc_id <> center").join(centers, ["band", "key"]).where(F.least("wa", "weight") >= threshold * F.greatest("wa", "weight"))
    stars = stars.select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = space.write(verified(stars, lists, threshold), "links-1")
    joined = connected_components(links, space, "cc-1")

    part = hits.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "key", "doc_id", "weight", F.coalesce("component", "doc_id").alias("c"))
    part = space.write(part, "parts")
    loose = part.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.sum("weight") / BLOCK_ITEMS).cast("int").alias("blocks")).where("lo < hi").select("band", "key", "blocks")
    loose = space.write(loose, "loose")
    links = links.union(space.write(across(part.join(loose, ["band", "key"]), distinct, lists, threshold), "links-2"))
    groups = connected_components(links, space, "cc-2")

    found = member.select("doc_id", "copy_of").join(groups.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    found = found.groupBy("doc_id").agg(F.min("copy_of").alias("copy_of"), F.min(F.coalesce("component", "copy_of")).alias("component_id"))
    found = space.write(found, "found")
    space.drop("member", "buckets", "hits", "involved", "shingles", "links-1", "links-2", "parts", "loose")
    out = ids.select("doc_id").distinct().join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"))
