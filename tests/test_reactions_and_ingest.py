import zipfile

import pytest
from pyspark.sql import functions as F

from bitsieve.config import EngineConfig
from bitsieve.functions.graph_columns import contains_graph, parsed, to_row
from bitsieve.functions.graphs import condensed_key, read_smiles
from bitsieve.operators import ingest, load, reactions
from bitsieve.plans import search_queries
from bitsieve.sources.store import SCHEMAS, Store, initialise


@pytest.fixture(scope="module")
def chain(spark):
    substances = spark.createDataFrame([(1, 10, None), (2, 20, None), (2, 21, None), (3, None, 5)], "substance long, molecule long, non_organic long")
    roles = spark.createDataFrame([(100, 1, False), (100, 2, True), (101, 1, True), (101, 1, True), (102, 3, False), (102, 2, True), (103, 1, None), (104, 1, False), (104, 2, True), (104, 3, False)], "reaction long, substance long, is_product boolean")
    return substances, roles


def test_lifting_is_a_bag_by_role(spark, chain):
    hits = spark.createDataFrame([("q", 10)], "query string, molecule long")
    got = lambda p: sorted(r.reaction for r in reactions.lifted(hits, *chain, p).collect())
    assert got(None) == [100, 101, 101, 103, 104] and got(True) == [101, 101] and got(False) == [100, 104]
    other = spark.createDataFrame([("q", 5)], "query string, non_organic long")
    assert sorted(r.reaction for r in reactions.lifted(other, *chain, None, component="non_organic").collect()) == [102, 104]


def test_all_components(spark, chain):
    name = F.coalesce(F.concat(F.lit("m"), F.col("molecule")), F.concat(F.lit("n"), F.col("non_organic")))
    asked = reactions.components(spark.createDataFrame([(100,), (102,)], "query long"), *chain).withColumn("component", name)
    used = chain[1].join(chain[0], "substance").withColumn("component", name)
    got = lambda fix: {(r.query, r.reaction) for r in reactions.holding_all(asked, used.where("is_product is not null"), fix_roles=fix).collect()}
    assert got(True) == got(False) == {(100, 100), (100, 104), (102, 102), (102, 104)}


def test_ranking(spark):
    rows = [(1, 1, 50, 7, 0.5), (1, 2, 50, 7, 0.5), (1, 2, 50, 8, 0.25), (1, 2, 50, 8, 0.25), (1, 1, 51, 9, 1.0)]
    hits = spark.createDataFrame(rows, "query long, component_no long, reaction long, molecule long, t double")
    assert {(r.reaction, r.molecules, r.score) for r in reactions.ranked(hits).collect()} == {(50, "7,7,8", 1.25), (51, "9", 1.0)}
    assert {(r.reaction, r.molecules, r.score) for r in reactions.ranked(hits, ordered=False).collect()} == {(50, "7,8", 2.0), (51, "9", 1.0)}
    centres = spark.createDataFrame([(1, "a"), (50, "a"), (51, ""), (2, None)], "id long, reaction_center string")
    assert [r.reaction for r in reactions.same_centre(reactions.ranked(hits), centres).collect()] == [50]


def test_parsing_and_quarantine(spark):
    rows = spark.createDataFrame([(0, "C1CCCCC1.CCO", "x"), (1, "C1CC", "x"), (2, None, "x"), (3, "[Na+].[Cl-]", "x"), (4, "OCC", "x")], "line_no long, smi string, error string")
    good, bad = ingest.parsed_components(rows, "smi", ["line_no"], max_radius=3)
    assert {r.line_no for r in bad.collect()} == {1, 2}
    got = good.collect()
    assert sorted((r.line_no, r.component_no, r.organic) for r in got) == [(0, 0, True), (0, 1, True), (3, 0, False), (3, 1, False), (4, 0, True)]
    assert len({bytes(r.signature) for r in got if (r.line_no, r.component_no) in {(0, 1), (4, 0)}}) == 1
    assert sorted(got, key=lambda r: r.line_no)[-1].fingerprint == sorted(set(sorted(got, key=lambda r: r.line_no)[-1].fingerprint))


def test_upsert(spark):
    stored = spark.createDataFrame([(7, b"a"), (9, b"b"), (1, None)], "id long, signature binary")
    new = spark.createDataFrame([(1, b"a"), (2, b"c"), (3, b"c"), (4, None), (5, b"d")], "seq long, signature binary")
    got = {r.seq: (r.stored_id, r.inserted) for r in ingest.dedup_upsert(new, stored, ["seq"]).collect()}
    assert got.keys() == {1, 2, 3, 5} and got[1] == (7, False)
    assert got[2][0] == got[3][0] and got[2][1] and not got[3][1] and {got[2][0], got[5][0]} == {10, 11}
    assert ingest.dedup_upsert(new.where("false"), stored, ["seq"]).count() == 0


def test_graph_test_in_batches(spark):
    g = spark.createDataFrame([("CCO", "OC"), ("CCO", "N"), ("CC", "CCO")], "a string, b string")
    part = lambda c: parsed(c).getField("components")[0].getField("structure")
    df = g.withColumn("t", part("a")).withColumn("q", part("b"))
    assert sorted((r.a, r.b, r.hit) for r in df.withColumn("hit", contains_graph("t", "q")).collect()) == [("CC", "CCO", False), ("CCO", "N", False), ("CCO", "OC", True)]


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO\nC x\n")
    with zipfile.ZipFile(tmp_path / "b.smi.zip", "w") as z:
        z.writestr("b.smi", "N")
    got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.raw) for r in ingest.smiles_lines(spark, str(tmp_path)).collect())
    assert got == [("a.smi", 0, "CCO"), ("a.smi", 1, "C x"), ("b.smi", 0, "N")]


def test_empty_store(spark, tmp_path):
    initialise(spark, str(tmp_path / "s"), EngineConfig())
    store = Store(spark, str(tmp_path / "s"))
    assert store.structures().count() == 0 and store.molecule_lsh().count() == 0
    assert all(spark.read.parquet(f"{tmp_path}/s/{n}.parquet").schema == s for n, s in SCHEMAS.items())


def test_composed_graphs_need_no_stored_one(spark, tmp_path):
    folder = str(tmp_path)
    pairs = lambda *numbers: [(i + 1, n) for i, n in enumerate(numbers)]
    uses = {  # CBr, O >> CO, Br: substance, is_product, numbers of its atoms
        100: [(1, False, (1, 2)), (3, False, (3,)), (2, True, (1, 3)), (4, True, (2,))],
        101: [(1, False, (11, 15)), (3, False, (12,)), (2, True, (11, 12)), (4, True, (15,))],  # the same
        102: [(1, False, (1, 2)), (3, False, (3,)), (2, True, (7, 3)), (4, True, (2,))],  # another carbon
        103: [(1, False, ()), (3, False, ()), (2, True, ()), (4, True, ())],  # elements clash
        200: [(1, False, (1, 1)), (3, False, (3,)), (2, True, (1, 3)), (4, True, (2,))],  # two atoms of one number
    }
    tables = {
        "molecule_structure": [(i, i, None, None, None, None, True, to_row(read_smiles(x)), None) for i, x in enumerate(("CBr", "CO", "O", "Br"), 1)],
        "non_organic": [], "cgr": [],
        "substance_structure": [(i, i, i, None, 1.0, None) for i in range(1, 5)],
        "reaction": [(r, None) for r in uses],
        "reaction_substance": [(10 * r + i, r, x, role, pairs(*n) or None) for r, rows in uses.items() for i, (x, role, n) in enumerate(rows)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    assert search_queries.rxn_exact(spark, folder).count() == 10 and search_queries.rxn_exact_mapped(spark, folder).count() == 0
    assert {(r.query, r.reaction) for r in search_queries.rxn_exact_composed(spark, folder).collect()} == {(100, 100), (100, 101)}


def test_condensed_graphs_with_other_charges_differ():
    g = [read_smiles(x) for x in ("C[O-:1]", "C[OH:1]", "C[OH2+:1]")]
    assert len({condensed_key(a, b) for a in g for b in g}) == 9


def written(spark, tmp_path):
    folder = str(tmp_path / "store")
    initialise(spark, folder, EngineConfig())
    return folder


def test_loading_substances_reuses_structures(spark, tmp_path):
    folder = written(spark, tmp_path)
    one = spark.createDataFrame([(0, "CCO.[Na+]", "a"), (1, "OCC", "b"), (2, "C1CC", "bad"), (3, None, "none"), (4, "C[C@H](F)O", "r"), (5, "C[C@@H](F)O", "s")], "line long, smi string, idx string")
    load.append(load.load_substances(one, "smi", ["line"], load.tables_of(spark, folder), name="idx"), spark, folder)
    t = {n: df.collect() for n, df in load.tables_of(spark, folder).items()}
    assert len(t["molecule_structure"]) == len(t["molecule"]) == 3 and len(t["non_organic"]) == 1  # the mirror images are two
    assert {r.molecule for r in t["molecule_structure"]} == {r.id for r in t["molecule"]}
    assert [r.name for r in sorted(t["substance"], key=lambda r: r.id)] == ["a", "b", "r", "s"] and len(t["substance_structure"]) == 5
    assert all((r.molecule is None) != (r.non_organic is None) for r in t["substance_structure"])
    reused = [r for r in t["substance_structure"] if r.mapping]
    assert len(reused) == 1 and {(p["from"], p["to"]) for p in reused[0].mapping} == {(1, 3), (2, 2), (3, 1)}
    # A second batch goes on from there, and finds what is stored.
    two = spark.createDataFrame([(0, "C(O)C"), (1, "CCN")], "line long, smi string")
    done = load.load_substances(two, "smi", ["line"], load.tables_of(spark, folder))
    assert done.tables["molecule_structure"].count() == 1 and done.quarantine.count() == 0
    load.append(done, spark, folder)
    tables = load.tables_of(spark, folder)
    assert all(df.select("id").distinct().count() == df.count() for n, df in tables.items() if "id" in df.columns)
    bands = EngineConfig().molecules.bands()[0]
    assert tables["molecule_lsh"].count() == 4 * bands
    before = {tuple(r) for r in tables["molecule_lsh"].collect()}
    load.rebuild_index(spark, folder, "molecule_structure", "molecule_lsh", EngineConfig().molecules)
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/molecule_lsh.parquet").collect()} == before


def test_loading_reactions(spark, tmp_path):
    folder = written(spark, tmp_path)
    lines = ["[CH3:1][Br:2].[OH2:3]>>[CH3:1][OH:3].[BrH:2]", "[CH3:7][Br:5].[OH2:9]>>[CH3:7][OH:9].[BrH:5]", "CC>>", "CC>CC", "C.C>>CC", "[CH4:1]>>[OH2:1]"]
    done = load.load_reactions(spark.createDataFrame(list(enumerate(lines)), "line long, rxn string"), "rxn", ["line"], load.tables_of(spark, folder))
    assert [r.line for r in done.quarantine.collect()] == [3]
    load.append(done, spark, folder)
    t = {n: df.collect() for n, df in load.tables_of(spark, folder).items()}
    assert len(t["reaction"]) == 5 and len(t["cgr"]) == 2 and len({r.cgrsmiles for r in t["cgr"]}) == 1
    centres = {r.id: r.reaction_center for r in t["reaction"]}
    assert centres[1] == centres[2] and centres[1] and not any(centres[i] for i in (3, 4, 5))
    assert len(t["reaction_substance"]) == len(t["substance"]) == 4 + 4 + 1 + 3 + 2
    roles = sorted((r.reaction, r.is_product) for r in t["reaction_substance"])
    assert roles[:4] == [(1, False), (1, False), (1, True), (1, True)]
    # Read back by role, the two reactions have the same condensed graph.
    keys = {r.reaction: r.key for r in search_queries._composed(spark, folder, spark.createDataFrame([(1,), (2,)], "reaction long")).collect()}
    assert keys[1] == keys[2] and keys[1]
    got = search_queries.reaction_graphs(spark, folder).where("reaction = 1").collect()[0]
    assert (got.reactants_atoms, got.reactants_bonds, got.products_atoms, got.products_bonds) == (3, 1, 3, 1)


def test_queries_that_are_refused(spark, chain):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query long")
    parts = spark.createDataFrame([(1, 10), (1, None), (2, None)], "query long, molecule long")
    searchable = spark.createDataFrame([(10,)], "molecule long")
    assert sorted(r.query for r in reactions.unsearchable(asked, parts, searchable).collect()) == [2, 3]
    with pytest.raises(ValueError, match="2, 3"):
        reactions.require_searchable(asked, parts, searchable)
    reactions.require_searchable(asked.where("query = 1"), parts, searchable)


@pytest.mark.parametrize("limit", [-0.1, 1.5, True, "0.5"])
def test_limits_are_checked(spark, small_dir, limit):
    for search in (search_queries.mol_similar, search_queries.mol_similar_exact, search_queries.cgr_similar_exact):
        with pytest.raises(ValueError):
            search(spark, small_dir, limit)


def test_further_structures_need_the_same_atoms(spark):
    g = lambda t: to_row(read_smiles(t))
    rows = [(1, g("CC=O"), g("C=CO")), (2, g("CCO"), g("CCN")), (3, g("CC"), None)]
    df = spark.createDataFrame(rows, f"id int, structure {SCHEMAS['molecule_structure']['structure'].dataType.simpleString()}, canonic {SCHEMAS['molecule_structure']['structure'].dataType.simpleString()}")
    assert {r.id: r.ok for r in df.select("id", load.compatible("structure", "canonic").alias("ok")).collect()} == {1: True, 2: False, 3: None}


@pytest.mark.parametrize("name, score, tie", [("rxn_similar", "score", "reaction"), ("rxn_substructure", "score", "reaction"), ("rxn_similar_center", "score", "reaction"), ("rxn_substructure_center", "score", "reaction"), ("cgr_similar", "t", "cgr"), ("mol_similar", "t", "molecule")])
def test_best_first(spark, small_dir, name, score, tie):
    rows = search_queries.QUERIES[name](spark, small_dir).collect()
    assert rows and rows == sorted(rows, key=lambda r: (r["query"], -r[score], r[tie]))


def test_settings_of_a_store_are_used(spark, tmp_path):
    from bitsieve.config import LshConfig

    folder = str(tmp_path / "s")
    initialise(spark, folder, EngineConfig(molecules=LshConfig(permutations=16, threshold=0.5)))
    assert Store(spark, folder).config().molecules == LshConfig(permutations=16, threshold=0.5)
    row = (1, 1, None, None, [1, 2, 3], 3, True, None, None)
    spark.createDataFrame([row], SCHEMAS["molecule_structure"]).write.mode("append").parquet(f"{folder}/molecule_structure.parquet")
    assert len(search_queries.minhash_sig(spark, folder).collect()[0].sig.split("-")) == 16


def test_line_numbers_over_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.smi").write_text("".join(f"{'C' * (i % 7 + 1)} {name}{i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = ingest.smiles_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4000 and all(r.raw.endswith(f" {r.file[-5]}{r.line_no}") for r in rows)
