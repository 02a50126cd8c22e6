"""Byte-pair merging of many short symbol sequences at once.

All sequences of one length form a matrix; every round each unfinished row does the one merge its agenda has on top
(least rank, leftmost among equals), so rows stay of equal length and finished rows leave.  The result is that of
working each sequence's agenda alone.  `skip` takes candidates out of the agenda (merge dropout).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from ._columnar import U64, mix

NONE = np.int32(2**31 - 1)
#: Sequences longer than this are merged one at a time with a heap.
LONGEST = 96


class PairTable:
    """(left, right) -> rank by open addressing; rank -> merged symbol, or where several share a rank (left, right) -> symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, rank: np.ndarray):
        keys = left.astype(U64) << U64(32) | right.astype(U64)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, U64)
        self.ranks = np.full(size, NONE, np.int32)
        at = self._slot(keys)
        for k, a, r in zip(keys.tolist(), at.tolist(), rank.tolist()):
            while int(self.keys[a]) not in (k, 0xFFFFFFFFFFFFFFFF):
                a = (a + 1) & (size - 1)
            if r < self.ranks[a]:
                self.keys[a], self.ranks[a] = k, r
        self.merged = np.zeros(int(rank.max()) + 1 if len(rank) else 1, np.int32)
        self.merged[rank] = merged
        shared = np.unique(rank[self.merged[rank] != merged])
        self.merged[shared] = -1
        self.several = {(int(a), int(b)): int(m) for a, b, m, r in zip(left, right, merged, rank) if self.merged[r] < 0}

    def symbols(self, rank: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of these ranks become."""
        out = self.merged[rank]
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = self.several[int(left[i]), int(right[i])]
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; symbols below 0 merge with nothing."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        keys = left.astype(U64) << U64(32) | right.astype(U64) & U64(0xFFFFFFFF)
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((got != keys) & (got != U64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got != U64(0xFFFFFFFFFFFFFFFF))]
        out[(left < 0) | (right < 0)] = NONE
        return out.reshape(shape)


Skip = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def keyed_skip(seed: int, rate: float) -> Skip:
    """Whether the merge of [start, mid) and [mid, end) in the sequence with key `key` is skipped: a hash of all four."""
    limit = U64(min(int(rate * 2.0**64), 2**64 - 1))
    salt = mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], U64))[0]

    def skip(key: np.ndarray, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
        place = start.astype(U64) << U64(42) | mid.astype(U64) << U64(21) | end.astype(U64)
        return mix(key ^ salt ^ (place * U64(0xD6E8FEB86659FD93))) < limit

    return skip


def merge_rows(ids: np.ndarray, pairs: PairTable, keys: np.ndarray | None = None, skip: Skip | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Rows of equal length, merged: symbols of all rows in order, counts by row, and with `skip` the symbols' end positions."""
    n, width = ids.shape
    counts = np.full(n, width, np.int64)
    final: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
    live = np.arange(n)
    ends = None
    if skip is not None:
        ends = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()

    def ranked(own, left, right, start, mid, end):
        r = pairs.lookup(left, right)
        if skip is not None:
            hot = np.flatnonzero(r.ravel() != NONE)
            k = np.broadcast_to(own.reshape(-1, *[1] * (left.ndim - 1)), left.shape).ravel()[hot]
            gone = skip(k, start.ravel()[hot], mid.ravel()[hot], end.ravel()[hot])
            r.reshape(-1)[hot[gone]] = NONE
        return r

    key = keys
    if width > 1:
        if skip is None:
            rank = pairs.lookup(ids[:, :-1], ids[:, 1:])
        else:
            starts = np.zeros_like(ends)
            starts[:, 1:] = ends[:, :-1]
            rank = ranked(key, ids[:, :-1], ids[:, 1:], starts[:, :-1], ends[:, :-1], ends[:, 1:])
    while width > 1 and len(live):
        best = rank.argmin(1)
        at = np.arange(len(live))
        low = rank[at, best]
        go = low != NONE
        if not go.all():
            stop = ~go
            final.append((live[stop], ids[stop], None if ends is None else ends[stop]))
            live, ids, rank, best, low = live[go], ids[go], rank[go], best[go], low[go]
            ends = None if ends is None else ends[go]
            key = None if key is None else key[go]
            at = np.arange(len(live))
            if not len(live):
                break
        ids[at, best] = pairs.symbols(low, ids[at, best], ids[at, best + 1])
        keep = np.ones((len(live), width), bool)
        keep[at, best + 1] = False
        ids = ids[keep].reshape(len(live), width - 1)
        if ends is not None:
            ends[at, best] = ends[at, best + 1]
            ends = ends[keep].reshape(len(live), width - 1)
        rank = rank[keep[:, 1:]].reshape(len(live), width - 2)
        width -= 1
        counts[live] = width
        for side in (0, 1):  # the pair that ends in the new symbol, and the one it begins
            p = best - 1 + side
            has = np.flatnonzero((p >= 0) & (p + 1 < width))
            q = p[has]
            if ends is None:
                rank[has, q] = pairs.lookup(ids[has, q], ids[has, q + 1])
            else:
                begin = np.where(q > 0, ends[has, np.maximum(q - 1, 0)], 0)
                rank[has, q] = ranked(key[has], ids[has, q], ids[has, q + 1], begin, ends[has, q], ends[has, q + 1])
    if len(live):
        final.append((live, ids, ends))
    offset = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offset[-1], np.int32)
    out_ends = None if skip is None else np.empty(offset[-1], np.int32)
    for rows, x, e in final:
        to = offset[rows][:, None] + np.arange(x.shape[1])
        out[to] = x
        if out_ends is not None:
            out_ends[to] = e
    return out, counts, out_ends


def merge_one(ids: list[int], pairs: PairTable, key: int = 0, skip: Skip | None = None) -> tuple[list[int], list[int]]:
    """One sequence with a heap; symbols and their end positions."""
    n = len(ids)
    ids, before, after = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    end = list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []
    k = np.array([key], U64)

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] < n]
        if not lefts:
            return
        rights = [after[i] for i in lefts]
        rank = pairs.lookup(np.array([ids[i] for i in lefts], np.int32), np.array([ids[j] for j in rights], np.int32))
        for i, j, r in zip(lefts, rights, rank.tolist()):
            if r != NONE and not (skip is not None and skip(k, np.array([i]), np.array([end[i]]), np.array([end[j]]))[0]):
                heapq.heappush(heap, (r, i, end[i], end[j]))

    offer(list(range(n)))
    while heap:
        r, i, mid, stop = heapq.heappop(heap)
        if ids[i] == -2 or end[i] != mid or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        ids[i], ids[j], end[i] = int(pairs.symbols(np.array([r]), [ids[i]], [ids[j]])[0]), -2, stop
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer([before[i], i])
    left = [i for i in range(n) if ids[i] != -2]
    return [ids[i] for i in left], [end[i] for i in left]
