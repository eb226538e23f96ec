import random

import numpy as np
import pytest

from bitsieve.llm.pivots import SLOTS, Bounds, Overlaps, Threshold, bucket_range, nearest, size_bucket
from bitsieve.llm.set_pairs import similar_pairs


def random_sets(rng, families, universe=3000, size=(1, 40), common=(1, 2, 3)):
    out = []
    for _ in range(families):
        core = rng.sample(range(universe), rng.randrange(*size))
        for _ in range(rng.randrange(1, 5)):
            s = set(core) | {c for c in common if rng.random() < 0.8}
            for _ in range(rng.randrange(0, 1 + len(core) // 4)):
                s.discard(rng.choice(core))
                if rng.random() < 0.7:
                    s.add(rng.randrange(universe))
            out.append(sorted(s))
    return out


def brute(sets, t):
    return {
        (a, b) for a, x in sets for b, y in sets
        if a < b and x and y and t.q * len(x & y) - t.p * len(x | y) >= int(t.strict)
    }


@pytest.mark.parametrize("t", [Threshold(7, 10, True), Threshold(1, 2, False), Threshold(9, 10, False)])
def test_against_brute_force(spark, t):
    rng = random.Random(t.p)
    rows = [(i, s) for i, s in enumerate(random_sets(rng, 60))]
    rows += [(1000, []), (1001, None), (1002, [-5, 70000, -5]), (1003, [70000, None, -5]), (1004, list(range(2000))), (1005, list(range(100, 2100))), (None, [1])]
    rows += [(2000 + i, [1, 2, 3]) for i in range(20)] + [(2020, [1, 2, 3, 4])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, s, 1) for i, s in rows + rows[:30]], "id long, fingerprint array<int>, shared int")
    got = similar_pairs(df, "id", "fingerprint", t).collect()
    assert len(got) == len({(r.id_a, r.id_b) for r in got})
    sets = {i: {v for v in s or [] if v is not None} for i, s in rows if i is not None}
    assert {(r.id_a, r.id_b) for r in got} == brute(list(sets.items()), t)
    assert all((r.shared, r.n_a, r.n_b) == (len(sets[r.id_a] & sets[r.id_b]), len(sets[r.id_a]), len(sets[r.id_b])) for r in got)


def test_between_tables(spark):
    rng = random.Random(8)
    sets = random_sets(rng, 30)
    left, right = [(i, s) for i, s in enumerate(sets) if i % 2], [(i, s) for i, s in enumerate(sets)]
    one, two = (spark.createDataFrame(x, "id long, f array<int>") for x in (left, right))
    t = Threshold(7, 10, True)
    got = {(r.id_a, r.id_b) for r in similar_pairs(one, "id", "f", t, other=(two, "id", "f")).collect()}
    assert got == {(a, b) for a, x in left for b, y in right if 10 * len(set(x) & set(y)) > 7 * len(set(x) | set(y))}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, f array<int>")
    assert similar_pairs(df, "id", "f", Threshold(7, 10, True)).count() == 0


def test_pivot_bounds_never_lose_a_partner():
    rng = random.Random(3)
    sets = [np.array(s) for s in random_sets(rng, 150, size=(1, 160)) if s]
    for t, smaller in ((Threshold(7, 10, True), True), (Threshold(9, 10, False), False)):
        o = Overlaps(sets[::5])
        shared = [o.of(s) for s in sets]
        assert all(shared[0][k] == len(np.intersect1d(sets[0], p)) for k, p in enumerate(sets[::5]))
        home = [nearest(v, len(s), o.sizes) for v, s in zip(shared, sets, strict=True)]
        stats = {}
        for s, v, h in zip(sets, shared, home, strict=True):
            key = h, int(size_bucket(len(s)))
            low, high = stats.get(key, (10**6, -1))
            stats[key] = min(low, v[h]), max(high, v[h])
        bounds = Bounds(len(o.sizes), [(*k, *v) for k, v in stats.items()], t, smaller_only=smaller)
        for y, v in zip(sets, shared, strict=True):
            cells = set(bounds.cells(v, len(y)))
            slots = set(bounds.slot[bounds.rows_for(v, len(y))])
            for x, h in zip(sets, home, strict=True):
                if (not smaller or len(x) <= len(y)) and t.passes(len(np.intersect1d(x, y)), len(x), len(y)):
                    assert h in cells and h * SLOTS + int(size_bucket(len(x))) in slots


def test_buckets():
    for n in [*range(1, 2000), 10**6]:
        low, high = bucket_range(int(size_bucket(n)))
        assert low <= n <= high
