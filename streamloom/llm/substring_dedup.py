"""Incremental removal of repeated passages, by a log-structured index of window fingerprints.

A window is `width` consecutive words.  Hashing and moving every window costs more than the texts, so each window is
filed under one of the grams (`GRAM` words) inside it, the one of least hash: equal windows choose equal grams, and
neighbouring windows mostly share theirs, so a document has one index row for about `width - GRAM` / 2 words:
(fp: the gram's hash, rh: hash of all words of the windows that chose it, doc_id, their first and last position).

The index is a log: each batch leaves one immutable run, bucketed and sorted by key (FingerprintIndex); `add` merge-joins a
batch with every run, and once there are more than `fan_in` of them they are merged into one, bucket by bucket.  `deduplicate`
feeds three batches with fan_in 1, so the third meets a compacted run.  A batch's row whose (fp, rh) an earlier document has is
covered whole, on those 128 bits.  Where only fp agrees, the texts of the two documents are read again and every window of those
rows is compared by two independent 64-bit hashes of its words (verification), so windows that straddle the end of a shared
passage are decided exactly.  What moves: grams and rows of a batch, each once, the bodies of runs once a batch where grams
agree in part, and texts once (by_key), however many batches there are.

Earlier means a smaller doc_id, in this batch or an earlier one; batches must come with ascending doc_id.  Coverage is
judged on the input.  Hot passages: first documents are grouped minima (combined before the shuffle), and joins meet
at most one row a key on the right, so adaptive execution may split the left; no list of a passage's documents is built.

Cases: a null text has no words; a text of fewer than `width` words is never covered; repeats inside one document
stay; an empty batch is a no-op; extra columns are not touched.  Of a table whose doc_ids are null or repeated, each row is a document under its row key
(row_keyed, given as `key`): rows without an id come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import Workspace
from ._columnar import _random_words, lean, mix, Polynomial, ragged, signed, text_slices, U64, Words

WIDTH = 50
GRAM = 10
#: Words handled at once; longer documents go in overlapping parts.
PART = 1 << 22
POSITION_BITS = U64(24)
BYTES, BYTES_2, ITEMS, ITEMS_2 = Polynomial(101), Polynomial(211), Polynomial(307), Polynomial(401)
GRAM_FACTORS = _random_words(503, 64) | U64(1)
ROW = "fp long, rh long, doc_id long, p1 int, p2 int"


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours (prefix and suffix minima of blocks)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def window_rows(words: Words, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(fp, rh, document of the slice, first position, last position) of each run of windows with one gram."""
    hashes = BYTES.of_bytes(words.data, words.starts, words.ends)
    out = []
    for a in range(0, len(words), PART):
        h = hashes[a : a + PART + width - 1]
        doc = words.doc[a : a + PART + width - 1]
        n = len(h)
        if n < width:
            continue
        grams = np.zeros(n - gram + 1, U64)
        for j in range(gram):
            grams += h[j : n - gram + 1 + j] * GRAM_FACTORS[j]
        grams = mix(grams)
        ranked = (grams >> POSITION_BITS << POSITION_BITS) | np.arange(len(grams), dtype=U64)
        anchor = (sliding_least(ranked, width - gram + 1) & ((U64(1) << POSITION_BITS) - U64(1))).astype(np.int64)
        starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        if not len(starts):
            continue
        anchor = anchor[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0) | (np.diff(doc[starts]) != 0)
        first = np.flatnonzero(new)
        p1, p2 = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        whole = ITEMS.ranges(ITEMS.prefix(h), p1, p2 + width)
        rh = mix(whole ^ ((anchor[first] - p1).astype(U64) * U64(0x9E3779B97F4A7C15)))
        d = doc[p1]
        out.append((grams[anchor[first]], rh, d, p1 + a - words.first[d], p2 + a - words.first[d]))
    if not out:
        return (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*out))


def fingerprints(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Index rows (ROW) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b, data, offsets in text_slices(batch.column(1)):
                fp, rh, d, p1, p2 = window_rows(Words(data, offsets), width, gram)
                yield pa.RecordBatch.from_arrays([pa.array(signed(fp)), pa.array(signed(rh)), pa.array(ids[a:b][d]), pa.array(p1.astype(np.int32)), pa.array(p2.astype(np.int32))], ["fp", "rh", "doc_id", "p1", "p2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(lean(run), ROW)


def window_hashes(parts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Two hashes of every window that starts in one of `spans` (p1, p2) of a document: doc_id, spans, text -> h1, h2, doc_id, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            spans, bounds = ragged(batch.column(1))
            spans = spans.reshape(-1, 2) if len(spans) and spans.ndim > 1 else spans
            for a, b, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                w1, w2 = (p.of_bytes(data, words.starts, words.ends) for p in (BYTES, BYTES_2))
                c1, c2 = ITEMS.prefix(w1), ITEMS_2.prefix(w2)
                own = spans[bounds[a] : bounds[b]].astype(np.int64)
                doc = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                p1, p2 = own >> 32, own & 0xFFFFFFFF
                size = p2 - p1 + 1
                pos = np.repeat(p1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                doc = np.repeat(doc, size)
                at = pos + words.first[doc]
                h1, h2 = ITEMS.ranges(c1, at, at + width), ITEMS_2.ranges(c2, at, at + width)
                for i in range(0, len(at), 1 << 20):
                    s = slice(i, i + (1 << 20))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(h1[s])), pa.array(signed(h2[s])), pa.array(ids[a:b][doc[s]]), pa.array(pos[s].astype(np.int32))], ["h1", "h2", "doc_id", "pos"])

    return parts.select("doc_id", "spans", "text").mapInArrow(lean(run), "h1 long, h2 long, doc_id long, pos int")


def packed(p1: str, p2: str):
    return F.shiftleft(F.col(p1).cast("long"), 32) + F.col(p2).cast("long")


class FingerprintIndex:
    """Sorted immutable runs below a Workspace; `add` deduplicates a batch against them and adds its own run.

    A run is two tables, bucketed and sorted by their keys: heads (a row a gram: fp, least and greatest rh) and bodies (a row a
    (fp, rh): its first document).  Each has one row a key, so a batch, grouped by the same key, is merge-joined with a run where
    the run lies, and no gram is too common for a task.
    """

    def __init__(self, space: Workspace, width: int = WIDTH, gram: int = GRAM, fan_in: int = 1):
        self.space, self.width, self.gram, self.fan_in = space, width, gram, fan_in
        self.runs: list[tuple[DataFrame, DataFrame]] = []
        self.names: list[tuple[str, str]] = []
        self.batches = 0

    def compact(self) -> None:
        """Merges all runs into one, bucket by bucket; the old ones go only once it is written."""
        if len(self.runs) < 2:
            return
        (heads, bodies), *others = self.runs
        for h, b in others:
            heads = heads.join(h.toDF("fp", "lo", "hi"), "fp", "full").select("fp", F.least("rlo", "lo").alias("rlo"), F.greatest("rhi", "hi").alias("rhi"))
            bodies = bodies.join(b.toDF("fp", "rh", "other"), ["fp", "rh"], "full").select("fp", "rh", F.least("f", "other").alias("f"))
        names = (f"heads-to-{self.batches}", f"bodies-to-{self.batches}")
        merged = (self.space.write_dealt(heads, names[0], "fp"), self.space.write_dealt(bodies, names[1], "fp", "rh"))
        for old in self.names:
            self.space.drop(*old)
        self.runs, self.names = [merged], [names]

    def add(self, batch: DataFrame, corpus: DataFrame, more: bool = True) -> DataFrame:
        """doc_id, spans (list of packed word ranges [p1, p2) that earlier documents have) for documents of the batch with any.

        corpus: doc_id, text of this batch and of all earlier ones, for verification.  more=False keeps no run of this batch.
        """
        b, space = self.batches, self.space
        self.batches += 1
        rows = space.write(fingerprints(batch, self.width, self.gram), f"rows-{b}")
        heads = rows.groupBy("fp").agg(F.min("rh").alias("rlo"), F.max("rh").alias("rhi"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        heads = space.write_dealt(heads, f"heads-of-{b}", "fp")
        met, earlier = heads, F.lit(False)
        for i, (h, _) in enumerate(self.runs):
            met = met.join(h.toDF("fp", f"rlo{i}", f"rhi{i}"), "fp", "left")
            earlier = earlier | F.col(f"rlo{i}").isNotNull()
        least, most = (F.least, F.greatest) if self.runs else (lambda c: F.col(c), lambda c: F.col(c))
        mixed = least("rlo", *[f"rlo{i}" for i in range(len(self.runs))]) < most("rhi", *[f"rhi{i}" for i in range(len(self.runs))])
        shared = space.write(met.where((F.col("lo") < F.col("hi")) | earlier).select("fp", mixed.alias("mixed")), f"shared-{b}")
        # Both sides are written, not dealt: adaptive execution can then split a hot gram's rows over tasks.
        hits = space.write(rows.join(shared, "fp"), f"hits-{b}")
        repeated = hits.groupBy("fp", "rh").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        again = F.col("n") > 1
        for i, (_, body) in enumerate(self.runs):
            repeated = repeated.join(body.select("fp", "rh", F.col("f.doc_id").alias(f"d{i}")), ["fp", "rh"], "left")
            again = again | F.col(f"d{i}").isNotNull()
        repeated = repeated.where(again).select("fp", "rh", least("first", *[f"d{i}" for i in range(len(self.runs))]).alias("first"))
        repeated = space.write(repeated, f"repeated-{b}")
        judged = hits.join(repeated, ["fp", "rh"], "left").withColumn("first", F.coalesce("first", "doc_id"))
        whole = judged.where("first < doc_id").select("doc_id", packed("p1", "p2").alias("span"))
        unsure = judged.where("first = doc_id and mixed").select("doc_id", packed("p1", "p2").alias("span"), F.lit(True).alias("fresh"))
        for _, body in self.runs:
            old = body.select("fp", "f.*").join(shared.where("mixed").select("fp"), "fp", "left_semi")
            unsure = unsure.union(old.select("doc_id", packed("p1", "p2").alias("span"), F.lit(False).alias("fresh")))
        spans = unsure.groupBy("doc_id").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.max("fresh").alias("fresh"))
        spans = space.write(spans, f"spans-{b}")
        texts = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id")
        windows = space.write(window_hashes(texts, self.width), f"windows-{b}")
        lowest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
        lowest = space.write(lowest, f"lowest-{b}")
        partly = windows.join(lowest, ["h1", "h2"]).where("doc_id > lo").select("doc_id", packed("pos", "pos").alias("span"))
        if self.runs:  # windows of earlier batches were judged with them
            partly = partly.join(spans.where("fresh").select("doc_id"), "doc_id", "left_semi")
        covered = whole.union(partly).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
        result = space.write(covered, f"covered-{b}")
        if more:
            bodies = rows.groupBy("fp", "rh").agg(F.min(F.struct("doc_id", "p1", "p2")).alias("f"))
            self.runs.append((heads.select("fp", "rlo", "rhi"), space.write_dealt(bodies, f"bodies-of-{b}", "fp", "rh")))
            self.names.append((f"heads-of-{b}", f"bodies-of-{b}"))
            if len(self.runs) > self.fan_in:
                self.compact()
        else:
            space.drop(f"heads-of-{b}")
        space.drop(*(f"{name}-{b}" for name in ("rows", "shared", "hits", "repeated", "spans", "windows", "lowest")))
        return result

    def close(self) -> None:
        for names in self.names:
            self.space.drop(*names)
        self.runs, self.names = [], []


def covered_mask(words: Words, spans: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window that starts in one of the documents' spans."""
    own = spans.astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, words.first[doc] + (own >> 32), 1)
    np.add.at(step, words.first[doc] + (own & 0xFFFFFFFF) + width, -1)
    return np.cumsum(step[:-1]) > 0


def strip(docs: DataFrame, covered: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """What is left of each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space); `key` as in deduplicate."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(covered.select(F.col("doc_id").alias("id"), "spans"), "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, bounds = ragged(batch.column(2))
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                gone = covered_mask(words, spans[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                removed = np.bincount(words.doc[gone], minlength=b - a)
                text, cut = words.joined(~gone)
                text = text.tobytes()
                kept = [hashlib.sha256(text[cut[i] : cut[i + 1]]).hexdigest() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts), pa.array(removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "spans").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def rewrite(docs: DataFrame, covered: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """The documents with all their columns; covered words are cut from `text` (the rest joined by one space), others stay untouched.

    Documents that lose all their words go; `key` as in deduplicate.
    """
    columns = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    at, key = columns.index("text"), f"c{columns.index(key)}"
    rows = own.join(covered.select(F.col("doc_id").alias("id"), "spans"), F.col(key).cast("long") == F.col("id"), "left").drop("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, bounds = ragged(batch.column(len(columns)))
            old, texts, keep = batch.column(at), [], []
            for a, b, data, offsets in text_slices(old):
                if bounds[a] == bounds[b]:
                    texts.append(old.slice(a, b - a))
                    keep.append(np.ones(b - a, bool))
                    continue
                words = Words(data, offsets)
                gone = covered_mask(words, spans[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                removed = np.bincount(words.doc[gone], minlength=b - a)
                text, cut = words.joined(~gone)
                text = text.tobytes()
                texts.append(pa.array([text[cut[i] : cut[i + 1]].decode() if removed[i] else old[a + i].as_py() for i in range(b - a)], old.type))
                keep.append((removed == 0) | (removed < words.counts))
            if texts:
                arrays = [batch.column(i) for i in range(len(columns))]
                arrays[at] = pa.concat_arrays(texts)
                yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(columns))]).filter(pa.array(np.concatenate(keep)))

    out = rows.mapInArrow(lean(run), own.schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def by_key(docs: DataFrame, space: Workspace, key: str = "doc_id") -> DataFrame:
    """The documents written once, dealt by `key` (unique): spans then come to the texts, and no text is moved again."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return space.write_dealt(docs.withColumn(key, F.col(key).cast("long")).repartition(n, key), "by-key", key)


def deduplicate(docs: DataFrame, space: Workspace, batches: int = 3, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """Covered spans of all documents, fed to one index as `batches` ranges of `key`, unique and without nulls; the result calls it doc_id."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    index, out = FingerprintIndex(space, width), None
    low, high = (0, 0) if low is None else (low, high)
    edges = [low + (high + 1 - low) * i // batches for i in range(batches)] + [high + 1]
    for i in range(batches):
        part = docs.where(F.col("doc_id").between(edges[i], edges[i + 1] - 1))
        got = index.add(part, docs.where(F.col("doc_id") < edges[i + 1]), more=i + 1 < batches)
        out = got if out is None else out.union(got)
    index.close()
    return out
