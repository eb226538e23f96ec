"""Into how many pivot cells each set of a table has to be replicated: ``python tests/llm/measure_pivots.py TABLE_FOLDER [PIVOTS...]``.

A set's home is the nearest of the pivots (a sample of the sets); it also has to go to every cell that can hold a partner no larger than itself,
by the triangle bound on shared items. Prints the mean and the largest number of cells, and the share of all sets that these cells hold.
"""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from bitsieve.llm.pivots import Bounds, Overlaps, Threshold, nearest, size_bucket  # noqa: E402


def replicas(sets: list[np.ndarray], pivots: int, threshold: Threshold, *, asked: int = 500) -> tuple[float, int, float]:
    """Mean and largest number of cells of ``asked`` sets, and the mean share of all sets in them."""
    rng = np.random.default_rng(1)
    o = Overlaps([sets[i] for i in rng.choice(len(sets), min(pivots, len(sets)), replace=False)])
    range_of: dict[tuple[int, int], tuple[int, int]] = {}
    held = np.zeros(o.k, np.int64)
    for s in sets:
        v = o.of(s)
        home = nearest(v, len(s), o.sizes)
        held[home] += 1
        key = home, int(size_bucket(len(s)))
        low, high = range_of.get(key, (1 << 30, -1))
        range_of[key] = min(low, int(v[home])), max(high, int(v[home]))
    bounds = Bounds(o.k, [(*k, *v) for k, v in range_of.items()], threshold, smaller_only=True)
    cells = [bounds.cells(o.of(sets[i]), len(sets[i])) for i in rng.choice(len(sets), min(asked, len(sets)), replace=False)]
    return float(np.mean([len(c) for c in cells])), max(len(c) for c in cells), float(np.mean([held[c].sum() for c in cells]) / len(sets))


if __name__ == "__main__":
    import duckdb

    rows = duckdb.execute("SELECT DISTINCT list_sort(list_distinct(fingerprint)) FROM read_parquet(?) WHERE len(list_distinct(fingerprint)) > 0", [f"{sys.argv[1]}/*.parquet" if os.path.isdir(sys.argv[1]) else sys.argv[1]]).fetchall()
    table = [np.array(r[0], np.int64) for r in rows]
    for k in map(int, sys.argv[2:] or ["256", "1024", "4096"]):
        mean, most, share = replicas(table, k, Threshold(7, 10, strict=True))
        print(f"{len(table)} sets, {k} pivots: {mean:.0f} cells a set, at most {most}; they hold {share:.3f} of all sets")
