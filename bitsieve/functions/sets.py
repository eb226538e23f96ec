"""Expressions over fingerprints: sorted sets of bits in an array column."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Modulus of the permutations; products of two numbers below it fit a long.
PRIME = (1 << 31) - 1


def bit_set(values: str | Column) -> Column:
    """Sorted distinct non-null bits; null stays null."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))


def shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def tanimoto(a: str, b: str) -> Column:
    """Shared bits over bits in either; null for two empty sets."""
    i = shared(a, b)
    return F.try_divide(i, F.size(a) + F.size(b) - i)


def contains_all(fingerprint: str, query: str) -> Column:
    """Every bit of the query is set."""
    return F.size(F.array_except(query, fingerprint)) == 0


def length_window(length: str | Column, query_length: Column) -> Column:
    """Lengths that an ordered containment search looks at: L to 10 L + 4."""
    c = F.col(length) if isinstance(length, str) else length
    return c.between(query_length, 10 * query_length + 4)


def coefficients(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """Factors and summands of n permutations, drawn uniformly."""
    rng = random.Random(seed)
    a = [rng.randrange(1, PRIME) for _ in range(n)]
    return list(zip(a, [rng.randrange(PRIME) for _ in range(n)], strict=True))


def minhash(bits: str, n: int = 64, seed: int = 42) -> Column:
    """Least image of the set under each of n permutations, in Arrow batches; null for a null or empty set."""
    a, b = (np.array(c, np.int64)[:, None] for c in zip(*coefficients(n, seed), strict=True))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def least(sets: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.list_flatten(sets).to_numpy(zero_copy_only=False).astype(np.int64) % PRIME
        full = np.flatnonzero(sizes)
        ends = np.r_[0, np.cumsum(sizes[full])]
        out = np.empty((len(full), n), np.int64)
        step = 0
        while step < len(full):  # some hundred thousand images at a time, or one set's
            to = max(step + 1, int(np.searchsorted(ends, ends[step] + 8192, side="right")) - 1)
            images = (a * values[ends[step] : ends[to]] + b) % PRIME
            out[step:to] = np.minimum.reduceat(images, ends[step:to] - ends[step], axis=1).T
            step = to
        offsets = pa.array(np.r_[0, np.cumsum(np.where(sizes > 0, n, 0))].astype(np.int32), mask=np.r_[sizes == 0, False])
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return least(F.col(bits))


def band_keys(signature: str | Column, bands: int, rows: int) -> Column:
    """One key per band: the band's part of the signature as text."""
    s = F.col(signature) if isinstance(signature, str) else signature
    return F.array(*(F.array_join(F.transform(F.slice(s, i * rows + 1, rows), lambda v: v.cast("string")), "-") for i in range(bands)))


def optimal_bands(threshold: float, permutations: int) -> tuple[int, int]:
    """Bands and rows that weigh false positives and false negatives alike at the threshold."""

    def area(f, low: float, high: float, steps: int = 200) -> float:
        width = (high - low) / steps
        return sum(f(low + (k + 0.5) * width) for k in range(steps)) * width

    best = None
    for b in range(1, permutations + 1):
        for r in range(1, permutations // b + 1):
            hit = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            error = 0.5 * area(hit, 0.0, threshold) + 0.5 * area(lambda s, hit=hit: 1 - hit(s), threshold, 1.0)
            if best is None or error < best[0]:
                best = error, b, r
    return best[1:]


def collision_chance(similarity: float, bands: int, rows: int) -> float:
    return 1 - (1 - similarity**rows) ** bands
