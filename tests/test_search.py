import random

import pytest
from pyspark.sql import functions as F

from bitsieve.config import EngineConfig, LshConfig, score_limit
from bitsieve.functions.sets import collision_chance, optimal_bands, tanimoto
from bitsieve.operators import search

EMPTY = "query long, fp array<int>"


def sets(rng, n, universe=300):
    base = [sorted(rng.sample(range(universe), rng.randrange(1, 30))) for _ in range(n // 3)]
    out = base[:]
    while len(out) < n:
        s = set(rng.choice(base))
        for _ in range(rng.randrange(4)):
            s ^= {rng.randrange(universe)}
        out.append(sorted(s))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = [(i, s) for i, s in enumerate(sets(rng, 150))]
    store = spark.createDataFrame(rows, "id long, fp array<int>")
    return rows, store.where("size(fp) > 0"), store.where("size(fp) > 0 and id % 5 = 0").select(F.col("id").alias("query"), "fp")


def t(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y))


@pytest.mark.parametrize("limit", [0.3, 0.5, 0.7, 0.9])
def test_exact_similarity(data, limit):
    rows, store, queries = data
    got = {(r.query, r.id): r.t for r in search.similar_exact(queries, store, "id", limit).collect()}
    want = {(i, j): t(x, y) for i, x in rows if i % 5 == 0 for j, y in rows if x and y and round(t(x, y), 9) > limit}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


@pytest.mark.parametrize("prefilter", [True, False])
def test_containment(data, prefilter):
    rows, store, queries = data
    got = {(r.query, r.id) for r in search.containing(queries, store, "id", prefilter=prefilter).collect()}
    want = {(i, j) for i, x in rows if i % 5 == 0 and x for j, y in rows if set(x) <= set(y) and (not prefilter or len(y) <= 10 * len(x) + 4)}
    assert got == want
    assert {(r.query, r.id) for r in search.contained_counts(queries, search.inverted(store, "id"), "id").collect()} == {(i, j) for i, x in rows if i % 5 == 0 and x for j, y in rows if set(x) <= set(y)}


def test_index_is_a_subset_with_the_expected_recall(data):
    rows, store, queries = data
    index = search.lsh_index(store, "id", LshConfig())
    keys = index.where("structure_id % 5 = 0").select(F.col("structure_id").alias("query"), "band", "key")
    got = {(r.query, r.structure_id) for r in search.lsh_candidates(keys, index).collect()}
    near = [(i, j) for i, x in rows if i % 5 == 0 and x for j, y in rows if y and t(x, y) > 0.85]
    found = sum(p in got for p in near) / len(near)
    assert found > 0.9 and all((i, i) in got for i, x in rows if i % 5 == 0 and x)


def test_bands_and_limits():
    assert optimal_bands(0.7, 64) == (8, 8)
    assert abs(collision_chance(0.8, 8, 8) - 0.770) < 0.001
    assert score_limit(None, 0.7) == 0.7 and score_limit(0, 0.7) == 0.0
    for bad in (-0.1, 1.1, "x", True):
        with pytest.raises(ValueError):
            score_limit(bad, 0.7)


def test_config_round_trip(spark):
    c = EngineConfig(molecules=LshConfig(threshold=0.5))
    assert EngineConfig.from_table(c.to_table(spark)) == c


def test_edges(spark):
    q = spark.createDataFrame([], EMPTY)
    store = spark.createDataFrame([(1, [1, 2])], "id long, fp array<int>")
    assert search.similar_exact(q, store, "id", 0.5).count() == 0 == search.containing(q, store, "id").count()
    both = spark.createDataFrame([([], []), ([1], None), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert [r.t for r in both.select(F.round(tanimoto("a", "b"), 6).alias("t")).collect()] == [None, None, 0.333333]
    few = spark.createDataFrame([(1, [1]), (2, list(range(14))), (3, list(range(15)))], "id long, fp array<int>")
    one = spark.createDataFrame([(9, [1])], EMPTY)
    assert {r.id for r in search.containing(one, few, "id").collect()} == {1, 2}
    best = search.distinct_on(few.withColumn("t", F.lit(0.5)), ["t"], [F.desc("id")]).collect()
    assert [r.id for r in best] == [3]


@pytest.mark.parametrize("k", [1, 7, 200])
def test_best_of_every_query(data, k, monkeypatch):
    monkeypatch.setattr(search, "STORE_BLOCK", 40)
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    rows, store, queries = data
    got = sorted((r.query, -r.t, r.molecule, r.id) for r in search.top_each(queries, store.withColumn("molecule", F.col("id") % 4), "id", k).collect())
    rank = lambda i, x: sorted((-round(t(x, y), 9), j % 4, j) for j, y in rows if y)[:k]
    want = [(i, *r) for i, x in rows if i % 5 == 0 and x for r in rank(i, x)]
    assert got == want and len({g[0] for g in got}) > 20 and (k < 200 or any(g[1] == 0 for g in got))


@pytest.mark.parametrize("bad", [-0.1, 1.1, "x", True])
def test_searches_refuse_bad_limits(data, bad):
    _, store, queries = data
    with pytest.raises(ValueError):
        search.similar_exact(queries, store, "id", bad)
    with pytest.raises(ValueError):
        search.scored(queries.select("query", F.col("query").alias("structure_id")), queries, store, "id", bad)
