"""Encoding to and decoding from a merge-type sentence piece model, with seeded merge dropout.

Encoding works each segment's agenda (a run of spaces and the characters up to the next space; no piece of such a
model crosses a segment's start): the adjacent pair whose concatenation is the piece of best score merges first.  With
dropout, every candidate merge is skipped when a keyed hash of (seed, doc_id, place of the segment, the pair's extent)
falls below the rate, so one document gets the same segmentation in every run, retry and partitioning, another seed or
document gets another one, and rate 0 is the model's own segmentation.

Whatever is not in the vocabulary goes as bytes, among it a literal U+2581 (the model writes a space so); decoding
therefore gives back every text exactly.

Cases: a null text stays null in `decode(encode)` and has no ids; an empty text has no ids and decodes to the empty one;
segments of any length are merged whole; repeated rows with one doc_id are segmented alike, rows without one as doc_id 0; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import LONGEST, PairTable, keyed_skip, merge_one, merge_rows
from ._columnar import lean, mix, text_slices, U64

SPACE = 0x2581
#: Stands for a literal U+2581 of a text: beyond all code points, hence never in a vocabulary.
LITERAL = 0x110000
SLICE = 1_000_000


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        normal: dict[str, int] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                normal[p] = i
        mark = chr(SPACE)
        if any(mark in p.lstrip(mark) for p in normal):
            raise ValueError("a piece of this model crosses a segment's start")
        self.single = np.full(LITERAL + 1, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        rows = [(normal[p[:k]], normal[p[k:]], i, -sp.get_score(i)) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        left, right, merged, score = (np.array(x) for x in zip(*rows))
        order = {s: r for r, s in enumerate(sorted(set(score.tolist())))}
        self.pairs = PairTable(left, right, merged, np.array([order[s] for s in score.tolist()]))
        raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(mark, " ").encode() if p in normal else b"" for i, p in enumerate(self.pieces)]
        self.lengths = np.array([len(r) for r in raw])
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, texts: list[str], doc_ids: np.ndarray, seed: int = 0, rate: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets."""
        docs = len(texts)
        size = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, docs)
        bounds = np.concatenate([[0], np.cumsum(size)])
        code = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64)
        code = np.where(code == SPACE, LITERAL, np.where(code == 0x20, SPACE, code))
        n = len(code)
        if not n:
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64)
        gap = code == SPACE
        fresh = np.ones(n, bool)
        fresh[1:] = gap[1:] & ~gap[:-1]
        starts_at = bounds[:-1][size > 0]
        fresh[starts_at] = True
        start = np.flatnonzero(fresh)
        width = np.diff(np.append(start, n))
        doc = np.searchsorted(bounds, start, "right") - 1
        ids = self.single[code]
        skip = keyed_skip(seed, rate) if rate > 0 else None
        keys = mix(mix(doc_ids.astype(np.int64).view(U64))[doc] + (start - bounds[doc]).astype(U64) * U64(0x9E3779B97F4A7C15))
        counts = np.zeros(len(start), np.int64)
        got = []
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            if w > LONGEST:
                for r in rows.tolist():
                    flat, _ = merge_one(ids[start[r] : start[r] + w].tolist(), self.pairs, int(keys[r]), skip)
                    counts[r] = len(flat)
                    got.append((np.array([r]), np.array(flat, np.int32)))
                continue
            flat, m, _ = merge_rows(ids[start[rows][:, None] + np.arange(w)], self.pairs, keys[rows], skip)
            counts[rows] = m
            got.append((rows, flat))
        offset = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offset[-1], np.int32)
        for rows, flat in got:
            m = counts[rows]
            out[np.repeat(offset[rows], m) + np.arange(len(flat)) - np.repeat(np.cumsum(m) - m, m)] = flat
        per_doc = np.bincount(doc, counts, docs).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(per_doc)])
        unknown = np.flatnonzero(out < 0)
        if len(unknown):  # in order the characters without a piece: each becomes its bytes
            raw = [chr(SPACE if c == LITERAL else c).encode() for c in code[ids < 0].tolist()]
            extra = np.array([len(r) for r in raw])
            repeat = np.ones(len(out), np.int64)
            repeat[unknown] = extra
            begin = np.cumsum(repeat) - repeat
            wide = np.repeat(out, repeat)
            at = np.repeat(begin[unknown], extra) + np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
            wide[at] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            cut = np.concatenate([[0], np.cumsum(repeat)])[cut]
            out = wide
        return out, cut

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """UTF-8 texts of id lists; the space set before each text goes."""
        n = self.lengths[ids]
        at = np.repeat(self.begin[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        data = self.raw[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[cut]
        return [data[a + 1 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, path: str, seed: int = 0, rate: float = 0.0) -> DataFrame:
    """doc_id, ids (null for a null text) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            doc_ids = np.asarray(batch.column(0).fill_null(0))
            missing = np.asarray(batch.column(1).is_null())
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                raw = data.tobytes()
                ids, cut = m.encode([raw[x:y].decode() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], doc_ids[a:b], seed, rate)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids), mask=pa.array(missing[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            column = batch.column(1)
            for a in range(0, batch.num_rows, 512):
                part = column.slice(a, 512)
                size = np.asarray(part.value_lengths().fill_null(0), np.int64)
                texts = m.decode(np.asarray(part.flatten()), np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), pa.array([t.decode() if ok else None for t, ok in zip(texts, part.is_valid().to_pylist())], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str, seed: int, rate: float) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32 bit), lossless: whether decoding gives the text back; ids stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            doc_ids = np.asarray(batch.column(0).fill_null(0))
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                raw = data.tobytes()
                texts = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ids, cut = m.encode([t.decode() for t in texts], doc_ids[a:b], seed, rate)
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                same = [x == y for x, y in zip(m.decode(ids, cut), texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(cut)), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_ids long, ids_crc32 long, lossless boolean")
