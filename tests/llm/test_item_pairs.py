import random
from collections import Counter
from itertools import combinations

import pytest

from bitsieve.llm.item_pairs import item_pairs


def brute(rows, n, min_count, min_lift):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    one = Counter(i for s in baskets.values() for i in s)
    two = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return {(a, b, one[a], one[b], c) for (a, b), c in two.items() if c >= min_count and c * n >= min_lift * one[a] * one[b]}


@pytest.mark.parametrize(("heavy_above", "max_heavy", "min_count", "min_lift"), [(10, 5, 1, 0.0), (3, 1000, 2, 1.5), (10**9, 10, 1, 0.0)])
def test_against_brute_force(spark, heavy_above, max_heavy, min_count, min_lift):
    rng = random.Random(5)
    rows = [(b, int(rng.paretovariate(0.6)) % 400) for b in range(120) for _ in range(rng.randrange(9))]
    rows += [(1000, i) for i in range(300)] + [(1001, i) for i in range(150, 390)]  # baskets of several chunks
    rows += rows[:50] + [(None, 1), (3, None), (None, None)]
    df = spark.createDataFrame([(b, i, "x") for b, i in rows], "basket long, item long, n_ab string")
    n = spark.createDataFrame([(200,)], "n long")
    got = item_pairs(df, n, min_count=min_count, min_lift=min_lift, heavy_above=heavy_above, max_heavy=max_heavy).collect()
    assert len(got) == len({(r.item_a, r.item_b) for r in got})
    assert {(r.item_a, r.item_b, r.n_a, r.n_b, r.n_ab) for r in got} == brute(rows, 200, min_count, min_lift)
    assert all(abs(r.lift - r.n_ab * 200 / (r.n_a * r.n_b)) < 1e-9 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "basket long, item long")
    assert item_pairs(df, spark.createDataFrame([(0,)], "n long"), min_count=1, min_lift=1.0).count() == 0
