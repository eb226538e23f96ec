"""Rows that a search moves: they follow its tables and results, not the pairs that it looks at."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitsieve.functions.graph_columns import _few, sides
from bitsieve.operators import reactions, search
from bitsieve.plans import search_queries
from bitsieve.sources.store import Store
from bitsieve.sources.tables import table


def shuffled(spark, df):
    """The rows of a plan, and how many records it wrote to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    written = lambda: sum((s := all_.apply(i)).shuffleWriteRecords() for all_ in [stages()] for i in range(all_.size()))
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    wait()
    before = written()
    rows = df.collect()
    wait()
    return rows, written() - before


@pytest.fixture(scope="module")
def crowd(spark):
    """Sets with half of all bits, of which any two share some of every few bits."""
    rng = random.Random(5)
    rows = [(i, sorted(rng.sample(range(60), 30))) for i in range(600)]
    store = spark.createDataFrame(rows, "id long, fp array<int>").localCheckpoint()
    return rows, store, store.select(F.col("id").alias("query"), "fp")


def test_exact_similarity_moves_no_candidates(spark, crowd):
    rows, store, queries = crowd
    got, moved = shuffled(spark, search.similar_exact(queries, store, "id", 0.7))
    t = lambda x, y: round(len(x & y) / len(x | y), 9)
    sets = {i: set(x) for i, x in rows}
    assert {(r.query, r.id): r.t for r in got} == {(i, j): t(x, y) for i, x in sets.items() for j, y in sets.items() if t(x, y) > 0.7}
    assert moved < 20 * len(rows)


def test_limited_index_search_moves_no_candidates(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i, sorted(rng.sample(range(60), 30)), True) for i in range(400)]
    rows += [(1000 + i, 1000 + i, rows[100 * i][2][:-1], True) for i in range(4)]
    spark.createDataFrame(rows, "id long, molecule long, fingerprint array<int>, is_canonic boolean").write.parquet(f"{tmp_path}/molecule_structure.parquet")
    spark.createDataFrame([(b, "hot" if r[0] != 1001 else "cold", r[0]) for r in rows for b in range(8)] * 2, "band int, key string, structure_id long").write.parquet(f"{tmp_path}/molecule_lsh.parquet")
    got, moved = shuffled(spark, search_queries.mol_similar(spark, str(tmp_path)))
    assert [(r.query, r.structure) for r in got] == [(q, s) for q in (0, 100, 200, 300) for s in (q, 1000 + q // 100) if s != 1001] + [(1000, 1000), (1000, 0)]
    assert moved < 40 * len(rows)


@pytest.mark.parametrize("k", [1, 7, 3000])
def test_best_reactions_move_no_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(reactions, "SLICE", 512)
    rng = random.Random(7)
    used = [(r, bool(r % 2), 0) for r in range(2000) for _ in range(2)] + [(rng.randrange(2000), rng.random() < 0.5, rng.randrange(1, 50)) for _ in range(3000)]
    hits = [(q, c, side, m, t) for q in range(150) for c, side, m, t in {(1, True, 0, 0.5), (2, False, 0, 0.25), (3, True, rng.randrange(1, 50), 1.0), (4, False, rng.randrange(1, 50), rng.choice([0.3, 0.333333333]))}]
    left = spark.createDataFrame(hits, "query long, component_no long, is_product boolean, molecule long, t double").localCheckpoint()
    right = spark.createDataFrame(used, "reaction long, is_product boolean, molecule long").localCheckpoint()
    got, moved = shuffled(spark, reactions.top_each(left, right, k))
    pairs = left.join(right.distinct(), ["molecule", "is_product"]).select("query", "component_no", "reaction", "molecule", "t")
    want = search.first_of(reactions.ranked(pairs), ["query"], [F.desc("score"), F.col("reaction")], k).select("query", "reaction", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert k == 3000 or moved < 15_000 + 2 * len(want)


@pytest.mark.parametrize("k", [1, 100])
def test_few_best_reactions_of_many_queries_move_reactions_once(spark, k):
    rng = random.Random(10)
    hits = [(q, 1, True, rng.randrange(3000), rng.choice([0.3, 0.5])) for q in range(9000)]
    used = [(r, True, rng.randrange(3000)) for r in range(20_000)]
    left = spark.createDataFrame(hits, "query long, component_no long, is_product boolean, molecule long, t double").localCheckpoint()
    right = spark.createDataFrame(used, "reaction long, is_product boolean, molecule long").localCheckpoint()
    got, moved = shuffled(spark, reactions.top_each(left, right, k))
    of = {}
    for r, _, m in used:
        of.setdefault(m, []).append(r)
    assert sorted(map(tuple, got)) == sorted((q, r, t) for q, _, _, m, t in hits for r in of.get(m, [])[:k])
    assert moved < 2.5 * len(used) + 4 * len(hits) + len(got)


@pytest.mark.parametrize("k", [1, 40, 3000])
def test_best_reactions_of_all_blocks(spark, monkeypatch, k):
    for name, value in (("QUERIES", (10, 60)), ("HITS", 300), ("REACTIONS", (100, 900)), ("SLICE", 128), ("TOGETHER", 8)):
        monkeypatch.setattr(reactions, name, value)
    rng = random.Random(11)
    used = [(rng.randrange(1200), rng.random() < 0.5, rng.randrange(60)) for _ in range(4000)]
    hits = [(q, c, rng.random() < 0.5, rng.randrange(60), rng.choice([0.25, 0.333333333])) for q in range(90) for c in range(6)]
    left = spark.createDataFrame(hits, "query long, component_no long, is_product boolean, molecule long, t double").localCheckpoint()
    right = spark.createDataFrame(used, "reaction long, is_product boolean, molecule long").localCheckpoint()
    pairs = left.join(right.distinct(), ["molecule", "is_product"]).select("query", "component_no", "reaction", "molecule", "t")
    want = search.first_of(reactions.ranked(pairs), ["query"], [F.desc("score"), F.col("reaction")], k).select("query", "reaction", "score").collect()
    assert len(want) >= 90 and sorted(map(tuple, reactions.top_each(left, right, k).collect())) == sorted(map(tuple, want))


def test_sizes_of_unions_need_no_graphs(spark, small_dir):
    roles = table(spark, small_dir, "reaction_substance").dropDuplicates(["id"])
    parts = search_queries._substance_parts(spark, small_dir).select("id", "substance", F.coalesce("structure", "other").alias("structure"), "mapping")
    made = reactions.by_role(roles, parts).withColumn("g", sides("substances"))
    want = made.select("reaction", *(F.size(f"g.{side}.{what}") for side in ("reactants", "products") for what in ("atoms", "bonds"))).collect()
    got = search_queries.reaction_graphs(spark, small_dir)
    assert want and sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "EvalPython" not in got._jdf.queryExecution().toString()


def test_graphs_of_a_batch_are_objects_a_few_at_a_time():
    rows = [None, *({"parts": [{"from": i, "to": None}]} for i in range(300))]
    got = list(_few(pa.array(rows).slice(1), 64))
    assert max(map(len, got)) == 64 and [x for some in got for x in some] == rows[1:]


@pytest.mark.parametrize("name", ["rxn_similar_center", "rxn_substructure_center"])
def test_other_centres_are_not_ranked(spark, small_dir, name):
    similar = name == "rxn_similar_center"
    every = search_queries._component_hits(spark, small_dir, similar=similar).select("query", "reaction").distinct().count()
    own = search_queries._component_hits(spark, small_dir, similar=similar, centre=True).select("query", "reaction").distinct().count()
    assert 0 < own == search_queries.QUERIES[name](spark, small_dir).count() < every


@pytest.mark.parametrize("find", [lambda q, s: search.containing(q, s, "id"), lambda q, s: search.similar_exact(q, s, "id", 0.5)])
def test_blocks_take_repeated_rows_once(spark, crowd, find):
    rows, store, queries = crowd
    want = {(r.query, r.id): r.t for r in find(queries, store).collect()}
    got, moved = shuffled(spark, find(queries, store.unionAll(store)))
    assert {(r.query, r.id): r.t for r in got} == want and len(got) == len(want) >= len(rows)
    assert moved < 4 * len(rows)


def test_queries_meet_a_store_in_one_block(spark, crowd, monkeypatch):
    rows, store, queries = crowd
    monkeypatch.setattr(search, "SETS", 200)
    got, moved = shuffled(spark, search.containing(queries, store, "id"))
    assert len(got) >= len(rows) and moved < 5 * len(rows)


@pytest.mark.parametrize("block", [1 << 18, 300])
@pytest.mark.parametrize("ordered", [True, False])
def test_ranked_reactions_move_no_pairs(spark, monkeypatch, ordered, block):
    monkeypatch.setattr(reactions, "BLOCK", block)
    rng = random.Random(8)
    used = [(r, bool(r % 2), 0) for r in range(1000) for _ in range(2)] + [(rng.randrange(1000), rng.random() < 0.5, rng.randrange(1, 40)) for _ in range(1500)] + [(None, True, 0)]
    hits = [(q, c, side, m, t) for q in range(60) for c, side, m, t in {(1, True, 0, 0.5), (1, True, 0, 0.0), (2, False, 0, 0.25), (3, True, rng.randrange(1, 40), 1.0), (4, False, rng.randrange(1, 40), rng.choice([0.3, 0.333333333]))}]
    left = spark.createDataFrame(hits, "query long, component_no long, is_product boolean, molecule long, t double").localCheckpoint()
    right = spark.createDataFrame(used, "reaction long, is_product boolean, molecule long").localCheckpoint()
    got, moved = shuffled(spark, reactions.ranked_in_blocks(left, right, ordered=ordered))
    pairs = left.join(right.distinct(), ["molecule", "is_product"]).select("query", "component_no", "reaction", "molecule", "t")
    want = reactions.ranked(pairs, ordered=ordered)
    want = (want.orderBy("query", F.desc("score"), "reaction") if ordered else want).collect()
    assert list(map(tuple, got)) == list(map(tuple, want)) if ordered else sorted(map(str, got)) == sorted(map(str, want))
    assert len(want) > 50_000 and (block < 1000 and ordered or moved < 20_000 + 60 * len(hits))


@pytest.mark.parametrize("block", [1 << 18, 100])
@pytest.mark.parametrize("name", ["rxn_similar", "rxn_similar_unordered", "rxn_substructure", "rxn_substructure_unordered"])
def test_reaction_searches_in_blocks(spark, small_dir, monkeypatch, name, block):
    monkeypatch.setattr(reactions, "BLOCK", block)
    monkeypatch.setattr(reactions, "KEPT", 1)
    monkeypatch.setattr(reactions, "SETS", 50)
    monkeypatch.setattr(reactions, "TIMES", 2 if block == 100 else 6)
    similar, ordered = "similar" in name, not name.endswith("unordered")
    got = search_queries.QUERIES[name](spark, small_dir).collect()
    want = reactions.ranked(search_queries._component_hits(spark, small_dir, similar=similar), ordered=ordered).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert not ordered or [(r.query, r.reaction) for r in got] == [(r.query, r.reaction) for r in sorted(want, key=lambda r: (r.query, -r.score, r.reaction))]


@pytest.mark.parametrize("ordered", [True, False])
def test_hot_band_keys_move_no_hits_into_reactions(spark, tmp_path, ordered):
    rng = random.Random(9)
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("molecule_structure", [(i, i // 2, sorted(rng.sample(range(60), 30)), i % 2 == 0) for i in range(800)], "id long, molecule long, fingerprint array<int>, is_canonic boolean")
    save("molecule_lsh", [(b, "hot" if b == 0 and i % 3 else str(i), i) for i in range(800) for b in range(2)], "band int, key string, structure_id long")
    save("substance_structure", [(i, i, i, None) for i in range(400)], "id long, substance long, molecule long, non_organic long")
    save("reaction", [(i,) for i in range(3000)], "id long")
    save("reaction_substance", [(3 * r + i, r, rng.randrange(400), i == 2) for r in range(3000) for i in range(3)], "id long, reaction long, substance long, is_product boolean")
    got, moved = shuffled(spark, search_queries.rxn_similar(spark, str(tmp_path), ordered=ordered))
    hits = search_queries._component_hits(spark, str(tmp_path), similar=True)
    want = reactions.ranked(hits, ordered=ordered).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 60_000
    assert moved < 60_000


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_reactions_of_a_centre_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(reactions, "CENTRED", block)
    rng = random.Random(10)
    used = [(r, rng.random() < 0.5, rng.randrange(8)) for r in range(1000) for _ in range(3)] + [(None, True, 0), (5000, True, 0)]
    hits = [(q, c, side, m, t) for q in range(0, 1000, 5) for c, side, m, t in {(1, True, 0, 0.5), (1, True, 0, 0.0), (2, False, 1, 0.25), (3, True, rng.randrange(8), 1.0)}] + [(6000, 1, True, 0, 0.5)]
    left = spark.createDataFrame(hits, "query long, component_no long, is_product boolean, molecule long, t double").localCheckpoint()
    right = spark.createDataFrame(used, "reaction long, is_product boolean, molecule long").localCheckpoint()
    named = [(r, rng.choice(["a", "b", "", None])) for r in range(1000)] + [(r, "b") for r in range(0, 1000, 50)] + [(6000, "c")]
    centres = spark.createDataFrame(named, "id long, reaction_center string").distinct().localCheckpoint()  # some have two
    got = reactions.ranked_in_blocks(left, right, centres=centres).collect()
    pairs = left.join(right.distinct(), ["molecule", "is_product"]).select("query", "component_no", "reaction", "molecule", "t")
    want = reactions.same_centre(reactions.ranked(pairs), centres).select(*got[0].__fields__).orderBy("query", F.desc("score"), "reaction").collect()
    assert [(r.query, r.score, r.reaction) for r in got] == [(r.query, r.score, r.reaction) for r in want] and sorted(map(str, got)) == sorted(map(str, want))
    assert len(want) > 5_000


def test_a_search_by_centre_moves_no_pairs(spark, tmp_path):
    rng = random.Random(11)
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("molecule_structure", [(i, i, sorted({0, *rng.sample(range(1, 9), 1 + i % 4)}), True) for i in range(40)], "id long, molecule long, fingerprint array<int>, is_canonic boolean")
    save("substance_structure", [(i, i, i, None) for i in range(40)], "id long, substance long, molecule long, non_organic long")
    save("reaction", [(r, "ab"[r % 7 == 0]) for r in range(8000)], "id long, reaction_center string")
    save("reaction_substance", [(3 * r + i, r, rng.randrange(40), i == 2) for r in range(8000) for i in range(3)], "id long, reaction long, substance long, is_product boolean")
    got, moved = shuffled(spark, search_queries.rxn_substructure_center(spark, str(tmp_path)))
    centres = table(spark, str(tmp_path), "reaction")
    want = reactions.same_centre(reactions.ranked(search_queries._component_hits(spark, str(tmp_path), similar=False, centre=True)), centres).select(*got[0].__fields__).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100_000
    assert [(r.query, r.reaction) for r in got] == [(r.query, r.reaction) for r in sorted(want, key=lambda r: (r.query, -r.score, r.reaction))]
    assert moved < 200_000


@pytest.mark.parametrize("role", ["", "_product"])
def test_similars_in_reactions_move_no_candidates(spark, tmp_path, monkeypatch, role):
    monkeypatch.setattr(reactions, "ROWS", 1000)
    rng = random.Random(12)
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("molecule_structure", [(25 * i, i // 2 if i % 9 else None, sorted(rng.sample(range(60), 30)), i % 2 == 0) for i in range(800)] + [(30000, 1, [], True)], "id long, molecule long, fingerprint array<int>, is_canonic boolean")
    save("molecule_lsh", [(b, "hot" if b == 0 and i % 3 else str(i), 25 * i) for i in range(1250) for b in range(2)], "band int, key string, structure_id long")
    save("substance_structure", [(i, i // 2, i if i % 5 else None, None) for i in range(800)] * 2, "id long, substance long, molecule long, non_organic long")
    save("reaction_substance", [(3 * r + i, r or None, rng.randrange(400), [None, False, True, True][rng.randrange(4)]) for r in range(500) for i in range(3)], "id long, reaction long, substance long, is_product boolean")
    d = str(tmp_path)
    got, moved = shuffled(spark, search_queries.QUERIES[f"similars_in_reactions{role}"](spark, d))
    s = Store(spark, d).structures()
    index = Store(spark, d).molecule_lsh()
    asked = index.where("structure_id % 100 = 0").withColumnRenamed("structure_id", "query")
    hits = search.scored(search.lsh_candidates(asked, index), search_queries._queries(s, "structure"), s, "structure", None).select("query", "molecule", "t").distinct()
    want = search_queries._lift(spark, d, hits, search_queries.ROLES[role]).select("query", "reaction", "molecule", "t").distinct().collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 1000 and {r.reaction is None for r in want} == {True, False}
    assert moved < 15_000


def test_an_unordered_search_sends_no_bits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reactions, "BLOCK", 100)
    rng = random.Random(13)
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("molecule_structure", [(i, i // 2, sorted(rng.sample(range(2000), 300)), i % 2 == 0) for i in range(800)] + [(900, 1, [], True)], "id long, molecule long, fingerprint array<int>, is_canonic boolean")
    save("molecule_lsh", [(b, "hot" if b == 0 and i % 3 else str(i % 700), i) for i in range(1000) for b in range(2)], "band int, key string, structure_id long")
    save("substance_structure", [(i, i, i, None) for i in range(400)], "id long, substance long, molecule long, non_organic long")
    save("reaction", [(i,) for i in range(1500)], "id long")
    save("reaction_substance", [(3 * r + i, r, rng.randrange(400), i == 2) for r in range(1500) for i in range(3)], "id long, reaction long, substance long, is_product boolean")
    gateway = spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    written = lambda: sum((s := all_.apply(i)).shuffleWriteBytes() for all_ in [stages()] for i in range(all_.size()))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = written()
    got = search_queries.rxn_similar(spark, str(tmp_path), ordered=False).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    moved = written() - before
    want = reactions.ranked(search_queries._component_hits(spark, str(tmp_path), similar=True), ordered=False).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10_000
    assert moved < 800 * 300 * 4  # less than all bits once
