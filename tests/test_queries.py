import pytest

from bitsieve.config import EngineConfig
from bitsieve.functions.graph_columns import from_row
from bitsieve.functions.graphs import fingerprint, read_smiles
from bitsieve.plans import registry
from bitsieve.sources.tables import table
from tests.compare import connect, differences

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small_dir, con, name):
    only_spark, only_sql = differences(QUERIES[name](spark, small_dir), con, SQL[name])
    assert not only_spark and not only_sql


@pytest.mark.parametrize("name", ["mol_substructure", "mol_substructure_unordered", "cgr_substructure", "cgr_substructure_unordered"])
def test_verified_hits_are_screened_hits_and_hold_the_query(spark, small_dir, name):
    screen = "mol_substructure_screen" if name.startswith("mol") else "cgr_substructure_screen"
    key = "molecule" if name.startswith("mol") else "cgr"
    hits = {(r["query"], r[key]) for r in QUERIES[name](spark, small_dir).collect()}
    if not name.endswith("unordered"):
        assert hits <= {(r["query"], r[key]) for r in QUERIES[screen](spark, small_dir).collect()}
    assert hits


def test_composed_graphs_keep_their_changes(spark, small_dir):
    rows = QUERIES["condensed_sides"](spark, small_dir).collect()
    assert rows and all(r.changed and r.changed > 0 for r in rows)


def test_fingerprints_follow_the_settings(spark, small_dir):
    c = EngineConfig().fingerprint
    own = lambda g: fingerprint(g, min_radius=c.min_radius, max_radius=c.max_radius, length=c.length, active_bits=c.number_active_bits, bit_pairs=c.number_bit_pairs)
    built = {r.id: r.bits for r in QUERIES["fp_build"](spark, small_dir).collect()}
    rows = table(spark, small_dir, "molecule_structure").where("structure is not null").collect()
    assert rows and all(built[r.id] == ",".join(map(str, own(from_row(r.structure.asDict(True))))) for r in rows)
    read = [r for r in QUERIES["smiles_parse"](spark, small_dir).collect() if r.smiles]
    assert read and all(r.fingerprint_len == len(own(read_smiles(r.smiles))) for r in read)
    assert c.max_radius == 6 and fingerprint(read_smiles("CCCCCCO")) == own(read_smiles("CCCCCCO"))
