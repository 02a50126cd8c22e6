"""Vectorised text primitives over Arrow buffers: words, hashes, sorted runs of bytes.

Texts stay as the UTF-8 bytes Arrow delivers; one numpy call handles all documents of a slice, so no Python
object is made per word.  Slices are bounded by bytes (one document longer than the bound is a slice of its own).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)

SLICE_BYTES = 500_000
U64 = np.uint64
#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _random_words(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Polynomial:
    """Hashes of any range of a sequence by prefix sums modulo 2**64; `seed` chooses an independent function."""

    def __init__(self, seed: int):
        self.table = _random_words(seed, 256)
        odd = int(_random_words(seed + 1, 1)[0]) | 5
        self.base, self.inverse = odd & ~2, pow(odd & ~2, -1, 1 << 64)
        self._pow, self._inv = np.ones(1, U64), np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self._pow) < n:
            n = max(n, 2 * len(self._pow), 1 << 16)
            for name, b in (("_pow", self.base), ("_inv", self.inverse)):
                x = np.full(n, b, U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self._pow[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Depends on the values of [start, end) and their number only, not on where the range lies."""
        return mix((prefix[ends] - prefix[starts]) * self._inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.ranges(self.prefix(self.table[data]), starts, ends)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `most` bytes, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


class Words:
    """The words of a slice of documents: byte ranges, and which document each is of."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        solid = ~WHITE[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            after[-1] = False
            after[:-1] = solid[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            before[inner] = False
            after[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # word index at which each document begins
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def joined(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the kept words, one space between those of a document, and the documents' offsets therein."""
        s, e, d = self.starts[keep], self.ends[keep], self.doc[keep]
        size = e - s
        last = np.ones(len(s), bool)
        last[:-1] = d[1:] != d[:-1]
        total = size + ~last
        to = np.zeros(len(s) + 1, np.int64)
        np.cumsum(total, out=to[1:])
        out = np.full(int(to[-1]), 0x20, np.uint8)
        n = int(size.sum())
        within = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to[:-1], size) + within] = self.data[np.repeat(s, size) + within]
        return out, to[np.searchsorted(d, np.arange(len(self.offsets)))]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each bounded slice of a string column."""
    data, offsets = text_buffers(column)
    for a, b in row_slices(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, after which the worker, which later tasks use again, hands its free memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column without nulls inside; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])
