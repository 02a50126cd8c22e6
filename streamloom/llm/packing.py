"""Packing documents into sequences along a Hilbert curve.

Each document's token counts are hashed to `HASHED` signed dimensions, scaled to length one and projected to `AXES`
fixed directions; the Hilbert index of the resulting grid point is its key, so documents of like vocabulary lie close on
the curve.  Documents are sorted by (key, hash of doc_id, doc_id), their tokens form one stream in that order, and the stream
is cut every `LENGTH` tokens: neighbours on the curve share sequences and nothing is padded but the stream's end,
which is itself cut into powers of two.

Scale: texts are tokenised once into a table; ranges of the sort key come from a quantile summary, one for `RANGE_BYTES` of ids (at
least one a shuffle partition), and a row finds its own by bisection; equal keys (copies) are split by the id's hash; the driver
sees one token total a range, and each range is numbered from the sum of those before it.

Tokens are those of the `tokenizers` library for a model of the "word BPE, lower case, white space dropped" kind: a
document of letters below U+0180 is cut into pieces and merged in numpy (see _bpe), each distinct piece of a slice once;
any other document, and any that has the text of an added token (`<|endoftext|>`), goes to the library itself, with its defaults.

Cases: null and empty texts are the end token alone; a document longer than a sequence is cut across several; ties in
the key go by doc_id; an empty table gives no rows; repeated doc_ids are packed each on its own, and so are rows without
one, whose id is hashed as 0 (ties among these go by their ids of tokens); extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bpe import LONGEST, PairTable, merge_rows
from ._cluster import Workspace
from ._columnar import _random_words, lean, mix, Polynomial, text_slices, U64

LENGTH = 2048
END = 1
HASHED, AXES, BITS = 64, 3, 10
SLICE = 1_000_000
#: Bytes of ids of a range of the curve, beyond as many ranges as there are shuffle partitions.
RANGE_BYTES = 32 << 20
PIECE = Polynomial(809)
LETTER, NUMBER, SPACE, OTHER, FOREIGN = range(5)
#: Code points below this can be cut here.
LATIN = 0x180


def byte_characters() -> dict[int, str]:
    """The usual reversible map of bytes to printable characters of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Vectorised twin of a tokenizers.Tokenizer of this kind; `encode` gives ids of whole documents."""

    def __init__(self, path: str):
        import unicodedata

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.added = [re.compile(re.escape(t["content"].encode())) for t in spec.get("added_tokens", [])]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right, merged = (np.array([vocab[x(m)] for m in merges]) for x in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        self.pairs = PairTable(left, right, merged, np.arange(len(merges)))
        names = byte_characters()
        self.inner = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + suffix] for b in range(256)], np.int32)
        kind = np.full(LATIN, OTHER, np.uint8)
        low = np.arange(LATIN, dtype=np.int32)
        for c in range(LATIN):
            category = unicodedata.category(chr(c))
            kind[c] = LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OTHER
            small = chr(c).lower()
            if len(small) == 1 and ord(small) < LATIN and (ord(small) < 0x80) == (c < 0x80) and unicodedata.normalize("NFC", chr(c)) == chr(c):
                low[c] = ord(small)
            else:
                kind[c] = FOREIGN
        kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
        kind[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0]] = FOREIGN  # white space to some, not to others: the library decides
        self.kind, self.low = kind, low

    @property
    def library(self):
        """The library's own tokenizer, loaded when the first document needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, starts and ends of pieces, their documents, and which documents need the library."""
        docs = len(offsets) - 1
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        b = data[at].astype(np.int32)
        two = (b >= 0xC0) & (b < 0xE0)
        code = b.copy()
        if two.any():
            code[two] = (b[two] & 0x1F) << 6 | (data[at[two] + 1] & 0x3F)
        strange = (b >= 0xE0) | (code >= LATIN)
        code[strange] = 0
        kind = self.kind[code]
        kind[strange] = FOREIGN
        bounds = np.searchsorted(at, offsets)  # characters by document
        foreign = np.zeros(docs, bool)
        odd = np.flatnonzero(kind == FOREIGN)
        foreign[np.searchsorted(bounds, odd, "right") - 1] = True
        raw = data.tobytes()
        for token in self.added:
            for m in token.finditer(raw):
                foreign[np.searchsorted(offsets, m.start(), "right") - 1] = True
        low = self.low[code]
        out = data.copy()
        changed = np.flatnonzero((low != code) & ~strange)
        one = changed[~two[changed]]
        out[at[one]] = low[one]
        pair = changed[two[changed]]
        out[at[pair]], out[at[pair] + 1] = 0xC0 | low[pair] >> 6, 0x80 | low[pair] & 0x3F

        n = len(at)
        begins = np.zeros(n + 1, bool)
        begins[bounds[:-1][bounds[:-1] < n]] = True
        fresh = begins[:n].copy()
        fresh[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        for q in self._contractions(low, kind, begins, n):
            size = 1 if low[q + 1] in (0x73, 0x74, 0x6D, 0x64) else 2
            fresh[q + 1 : q + 1 + size] = False
            if q + 1 + size < n and not begins[q + 1 + size] and kind[q + 1 + size] == LETTER:
                fresh[q + 1 + size] = True
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], n)
        solid = kind[start] != SPACE
        byte_at = np.append(at, len(data))
        start, end = start[solid], end[solid]
        doc = np.searchsorted(bounds, start, "right") - 1
        own = ~foreign[doc]
        return out, byte_at[start[own]], byte_at[end[own]], doc[own], foreign

    @staticmethod
    def _contractions(low, kind, begins, n) -> list[int]:
        """Apostrophes that begin a piece and are followed by s, t, m, d, re, ve or ll of the same document."""
        q = np.flatnonzero(low == 0x27)
        q = q[q + 1 < n]
        q = q[~begins[q + 1] & (kind[q + 1] == LETTER)]
        q = q[begins[q] | (kind[np.maximum(q - 1, 0)] != OTHER)]
        found = []
        for i in q.tolist():
            a = low[i + 1]
            b = low[i + 2] if i + 2 < n and not begins[i + 2] else 0
            if a in (0x73, 0x74, 0x6D, 0x64) or (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
                found.append(i)
        return found

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (all in order) and how many each has."""
        size = ends - starts
        counts = np.zeros(len(starts), np.int64)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(size).tolist():
            rows = np.flatnonzero(size == width)
            if width > LONGEST:
                for r in rows.tolist():
                    ids = np.array(self.library.encode(data[starts[r] : ends[r]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
                    counts[r] = len(ids)
                    got.append((np.array([r]), ids))
                continue
            letters = data[starts[rows][:, None] + np.arange(width)]
            ids = self.inner[letters]
            ids[:, -1] = self.last[letters[:, -1]]
            flat, n, _ = merge_rows(ids, self.pairs)
            counts[rows] = n
            got.append((rows, flat))
        offset = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offset[-1], np.int32)
        for rows, flat in got:
            n = counts[rows]
            out[np.repeat(offset[rows], n) + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice and their offsets."""
        docs = len(offsets) - 1
        low, starts, ends, doc, foreign = self.pieces(data, offsets)
        first, inverse = distinct_pieces(low, starts, ends)
        ids, counts = self.merge(low, starts[first], ends[first])
        begin = np.concatenate([[0], np.cumsum(counts)])
        n = counts[inverse]
        flat = ids[np.repeat(begin[inverse], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        per_doc = np.bincount(doc, n, docs).astype(np.int64)
        if not foreign.any():
            return flat, np.concatenate([[0], np.cumsum(per_doc)])
        cut = np.concatenate([[0], np.cumsum(per_doc)])
        parts = [flat[cut[i] : cut[i + 1]] for i in range(docs)]
        for i in np.flatnonzero(foreign).tolist():
            parts[i] = np.array(self.library.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def distinct_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct piece, and of every piece its number therein: grouped by hash, then compared byte by byte."""
    _, first, inverse = np.unique(PIECE.of_bytes(data, starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, first[inverse]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    same = (size == size[like])[np.repeat(np.arange(len(size)), size)]
    theirs = np.minimum(np.repeat(starts[like], size) + step, len(data) - 1)
    same &= data[np.repeat(starts, size) + step] == data[theirs]
    odd = np.unique(np.repeat(np.arange(len(size)), size)[~same])  # of equal hash only: each is told apart by itself
    inverse = inverse.copy()
    inverse[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), inverse


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid points (rows), each coordinate of `bits` bits.

    Axes to transpose by undoing excess rotations from the top bit down, then Gray decoding, then interleaving.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


class CurveKeys:
    """Hilbert keys of token lists: token -> signed hashed dimension, then a fixed projection."""

    def __init__(self, vocabulary: int):
        h = _random_words(911, vocabulary)
        self.slot = (h % U64(HASHED)).astype(np.int64)
        self.sign = np.where(h >> U64(63) == 1, -1.0, 1.0)
        g = _random_words(919, HASHED * AXES)
        self.axes = np.where(g >> U64(63) == 1, -1.0, 1.0).reshape(HASHED, AXES)

    def of(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs = len(offsets) - 1
        doc = np.repeat(np.arange(docs), np.diff(offsets))
        x = np.bincount(doc * HASHED + self.slot[ids], self.sign[ids], docs * HASHED).reshape(docs, HASHED).astype(float)  # of no token at all: whole numbers
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        point = np.clip((x @ self.axes / 3 + 1) / 2, 0, 1)  # each axis spreads like a unit normal; 3 covers nearly all
        return hilbert_index(np.minimum((point * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key (curve position, then 30 bits of the id's hash), n_ids, ids (little-endian 16 or 32 bit, end token included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        size = t.size
        keys = CurveKeys(size)
        kind = np.uint16 if size <= 65536 else np.uint32
        for batch in batches:
            doc_ids = np.asarray(batch.column(0).fill_null(0))
            for a, b, data, offsets in text_slices(batch.column(1), SLICE):
                ids, cut = t.encode(data, offsets)
                key = keys.of(ids, cut) << 30 | (mix(doc_ids[a:b].astype(np.int64).view(U64)) >> U64(34)).astype(np.int64)
                end = cut[1:] + np.arange(1, b - a + 1)
                flat = np.empty(len(ids) + b - a, kind)
                mask = np.ones(len(flat), bool)
                mask[end - 1] = False
                flat[mask], flat[~mask] = ids, END
                raw, at = flat.tobytes(), np.concatenate([[0], end]) * flat.itemsize
                buffers = [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(key), pa.array(np.diff(np.concatenate([[0], end]))), pa.Array.from_buffers(pa.binary(), b - a, buffers)], ["doc_id", "key", "n_ids", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, key long, n_ids long, ids binary")


def tail_cuts(total: int, length: int) -> list[int]:
    """Ends of the sequences of the last, partial stretch: powers of two, so that none needs padding."""
    out, at = [], total // length * length
    for bit in range(length.bit_length() - 1, -1, -1):
        if total - total // length * length & 1 << bit:
            at += 1 << bit
            out.append(at)
    return out


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are less than `key`, by bisection."""
    if not bounds:
        return F.lit(0)
    at, steps = F.lit(bounds).cast("array<bigint>"), [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) < key, n + step).otherwise(n))


def pack(docs: DataFrame, path: str, space: Workspace, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids (array<int>)."""
    spark = docs.sparkSession
    rows = space.write(tokenised(docs, path), "tokens")
    size = rows.agg(F.sum(F.length("ids"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bounds = rows.agg(F.percentile_approx("key", [(i + 1) / ranges for i in range(ranges - 1)] or [0.5], 20 * ranges)).first()[0] or []
    part = range_of(F.col("key"), sorted(set(bounds)))
    rows = rows.withColumn("part", part)
    totals = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number a range
    base, total = {}, 0
    for p in sorted(totals):
        base[p] = total
        total += totals[p]
    full, tail = total // length, tail_cuts(total, length)
    kind = np.uint16 if tokenizer(path).size <= 65536 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for part, doc_id, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if part != last:
                    last, at = part, base[part]
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                start = 0
                while start < n:
                    place = at + start
                    if place < full * length:
                        sequence, begin = divmod(place, length)
                        end = (sequence + 1) * length
                    else:
                        i = next(i for i, e in enumerate(tail) if place < e)
                        sequence, end = full + i, tail[i]
                        begin = place - (tail[i - 1] if i else full * length)
                    size = min(n - start, end - place)
                    piece = ids[start : start + size]
                    for column, value in zip(out, (doc_id, start, size, zlib.crc32(piece.tobytes()), n, sequence, begin)):
                        column.append(value)
                    if with_ids:
                        out[7].append(piece.astype(np.int32))
                    start += size
                at += n
            arrays = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, [*"doc_id start length ids_crc32 doc_tokens sequence_id offset".split(), *["ids"] * with_ids])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    placed = rows.repartitionById(ranges, "part").sortWithinPartitions("part", "key", "doc_id", "ids")
    return placed.select("part", "doc_id", "n_ids", "ids").mapInArrow(lean(run), schema)
