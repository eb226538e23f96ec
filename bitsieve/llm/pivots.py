"""Pivots for sets: overlaps with a bounded sample of sets, and bounds from the triangle inequality.

A set is known here by its size and the number of items it shares with each pivot.
For two sets x, y of sizes n, m whose Jaccard similarity passes a threshold p/q, the shared
items number at least ``least_shared(n, m)``, so y lacks at most ``n - least`` items of x and has
at most ``m - least`` others. The triangle inequality, in the metric |x - y| + |y - x| taken one side at a time,
then bounds y's overlap with any pivot by that of x:

    overlap(x) - (n - least) <= overlap(y) <= overlap(x) + (m - least).

In terms of Jaccard distance alone the same bound is looser (0.3 on either side at a threshold
of 0.7, where nearly all distances lie between 0.8 and 1), hence this form.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np

NEVER = 1 << 29
#: Size buckets of a cell have numbers below this: a slot is cell * SLOTS + bucket.
SLOTS = 4096


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity above p/q: strictly, or also at it."""

    p: int
    q: int
    strict: bool

    def least_shared(self, total):
        """The least number of shared items, for sizes that add up to ``total``."""
        if self.strict:
            return self.p * total // (self.p + self.q) + 1
        return -(-self.p * total // (self.p + self.q))

    def passes(self, shared, n, m):
        return shared >= self.least_shared(n + m)


def size_bucket(n):
    """Sizes up to 128 have a bucket each; above, buckets grow by an eighth of a power of two."""
    n = np.asarray(n, np.int64)
    high = np.maximum(n, 1)
    log = np.floor(8 * np.log2(high / 128.0 + 1e-12)).astype(np.int64)
    return np.where(n <= 128, n, 129 + np.maximum(log, 0))


def bucket_range(b: int) -> tuple[int, int]:
    """Smallest and largest size of a bucket, with one to spare for rounding."""
    if b <= 128:
        return b, b
    k = b - 129
    return max(129, int(128 * 2 ** (k / 8)) - 1), int(128 * 2 ** ((k + 1) / 8)) + 1


class Overlaps:
    """Shared items of sets with each of K pivots."""

    def __init__(self, pivots: list[np.ndarray]):
        self.sizes = np.array([len(p) for p in pivots], np.int64)
        self.k = len(pivots)
        flat = np.concatenate(pivots) if pivots else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(self.k), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.items, starts = np.unique(flat[order], return_index=True)
        self.owner = owner[order]
        self.starts = np.append(starts, len(flat))
        kind = np.uint8 if self.sizes.max(initial=0) < 256 else np.int32
        self.table = None
        if len(self.items) * self.k * np.dtype(kind).itemsize <= 64 << 20:
            self.table = np.zeros((len(self.items), self.k), kind)
            self.table[np.repeat(np.arange(len(self.items)), np.diff(self.starts)), self.owner] = 1

    def of(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.items, values)
        at = at[at < len(self.items)] if not len(self.items) else at[(at < len(self.items)) & (self.items[np.minimum(at, len(self.items) - 1)] == values)]
        if self.table is not None:
            return self.table[at].sum(axis=0, dtype=self.table.dtype).astype(np.int64)
        parts = [self.owner[self.starts[i] : self.starts[i + 1]] for i in at]
        return np.bincount(np.concatenate(parts) if parts else np.zeros(0, np.int64), minlength=self.k)


def kept(key: str, make):
    """``make()`` once per Python worker and key."""
    cache = sys.__dict__.setdefault("_bitsieve_kept", {})
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]


class Bounds:
    """Which cells can hold a partner of a set: from the (size, overlap) pairs of their members.

    ``rows``: (cell, size bucket of members, least overlap, largest overlap). ``smaller_only``: a partner
    is never larger than the set asked about.
    """

    def __init__(self, k: int, rows: list[tuple[int, int, int, int]], threshold: Threshold, *, smaller_only: bool):
        self.k, self.t, self.smaller_only = k, threshold, smaller_only
        self.rows = np.array(rows, np.int64).reshape(-1, 4)
        self.slot = self.rows[:, 0] * SLOTS + self.rows[:, 1]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.by_row: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _beyond(self, b: int, m: int) -> tuple[int, int] | None:
        """The most that a member of size bucket b may have beyond a match of size m, and the match beyond it; None if no sizes fit."""
        n0, n1 = bucket_range(b)
        if self.smaller_only and n0 > m:
            return None
        n = np.arange(n0, (min(n1, m) if self.smaller_only else n1) + 1)
        least = self.t.least_shared(n + m)
        fits = (least <= n) & (least <= m)
        return (int((n - least)[fits].max()), int((m - least)[fits].max())) if fits.any() else None

    def limits(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Per cell, the least and largest overlap with its pivot that a set of size m needs."""
        if m not in self.by_size:
            low, high = np.full(self.k, NEVER), np.full(self.k, -NEVER)
            for b in np.unique(self.rows[:, 1]):
                beyond = self._beyond(int(b), m)
                if not beyond:
                    continue
                rows = self.rows[self.rows[:, 1] == b]
                np.minimum.at(low, rows[:, 0], rows[:, 2] - beyond[0])
                np.maximum.at(high, rows[:, 0], rows[:, 3] + beyond[1])
            if len(self.by_size) > 4096:
                self.by_size.clear()
            self.by_size[m] = low, high
        return self.by_size[m]

    def rows_for(self, overlaps: np.ndarray, m: int) -> np.ndarray:
        """Numbers of the rows (cell and size bucket) whose members can match a set of size m with these overlaps."""
        if m not in self.by_row:
            low, high = np.full(len(self.rows), NEVER), np.full(len(self.rows), -NEVER)
            for b in np.unique(self.rows[:, 1]):
                if beyond := self._beyond(int(b), m):
                    at = self.rows[:, 1] == b
                    low[at], high[at] = self.rows[at, 2] - beyond[0], self.rows[at, 3] + beyond[1]
            if len(self.by_row) > 4096:
                self.by_row.clear()
            self.by_row[m] = low, high
        low, high = self.by_row[m]
        met = overlaps[self.rows[:, 0]]
        return np.flatnonzero((met >= low) & (met <= high))

    def cells(self, overlaps: np.ndarray, m: int) -> np.ndarray:
        low, high = self.limits(m)
        return np.flatnonzero((overlaps >= low) & (overlaps <= high))


def nearest(overlaps: np.ndarray, n: int, sizes: np.ndarray) -> int:
    """The pivot of least Jaccard distance; the first of equals."""
    return int(np.argmax(overlaps / np.maximum(n + sizes - overlaps, 1)))
