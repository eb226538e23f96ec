import random

import pytest

from bitsieve.llm.packing import CapacityTree, best_fit_decreasing, packed_containers


def plain_bfd(sizes, capacity):
    """One item at a time, by trying every container."""
    left = []
    for s in sorted(sizes, reverse=True):
        fit = [c for c in left if c >= s]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - s)
        else:
            left.append(capacity - s)
    return sorted(left)


def from_plan(counts, capacity):
    used = {}
    plan = best_fit_decreasing(counts, capacity)
    for size, n in counts.items():
        rows = sorted(p[1:] for p in plan if p[0] == size)
        for rank in range(n):
            first, each, start = [r for r in rows if r[0] <= rank][-1]
            used.setdefault(start + (rank - first) // each, []).append(size)
    return used


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 128, 2048])
    counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))}
    used = from_plan(counts, capacity)
    assert sorted(used) == list(range(len(used)))
    left = sorted(capacity - sum(v) for v in used.values())
    assert left == plain_bfd([s for s, n in counts.items() for _ in range(n)], capacity) and left[0] >= 0


def test_tree():
    t = CapacityTree(20)
    t.add(7, 2), t.add(19, 1)
    assert [t.tightest(s) for s in (1, 7, 8, 19, 20)] == [7, 7, 19, 19, None]
    t.add(7, -2)
    assert t.tightest(1) == 19


def test_operator(spark, monkeypatch):
    monkeypatch.setattr("bitsieve.llm.packing.RANKED", 7)
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 5, 5, 5, 40, rng.randrange(1, 130)])) for i in range(400)] + [(900, 0), (901, None), (902, 1000), (903, 50), (3, 5), (3, 5), (None, 9)]
    out = packed_containers(spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id long, n long, container string"), "doc_id", "n", 50).collect()
    fill, whole = {}, {}
    for r in out:
        fill[r.container] = fill.get(r.container, 0) + r.piece_size
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.piece_size
        assert r.piece_size == 50 or r.piece_no * 50 + r.piece_size == r.piece_from + r.piece_size
    assert max(fill.values()) <= 50 and sorted(fill) == list(range(len(fill)))
    want = {}
    for i, n in rows:
        if n:
            want[i] = want.get(i, 0) + n
    assert whole == want
    pieces = [s for _, n in rows if n for s in [50] * (n // 50) + [n % 50] * (n % 50 > 0)]
    assert sorted(50 - v for v in fill.values()) == plain_bfd(pieces, 50)


def test_empty(spark):
    assert packed_containers(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n", 50).count() == 0
