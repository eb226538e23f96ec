import random

import pytest
from pyspark.sql import functions as F

from bitsieve.llm.arrivals import MixtureIndex, SetIndex, in_batches, in_order, settle
from bitsieve.llm.pivots import Threshold


def jaccard_passes(x, y, t):
    return bool(x and y) and t.q * len(x & y) - t.p * len(x | y) >= int(t.strict)


def brute_sets(known, arrivals, t):
    keys, sets, out = {k for k, _ in known if k}, [frozenset(s or ()) for _, s in known], {}
    for seq, _, key, s in sorted(arrivals, key=lambda a: (a[1] is None, a[1], a[0])):
        s = frozenset(s or ())
        if key and key in keys:
            out[seq] = "exact"
        elif any(jaccard_passes(s, k, t) for k in sets):
            out[seq] = "near"
        else:
            keys.add(key)
            sets.append(s)
    return out


@pytest.mark.parametrize("pivots", [1, 40])
def test_sets_against_brute_force(spark, pivots):
    rng, t = random.Random(pivots), Threshold(9, 10, False)
    families = [sorted(rng.sample(range(900), rng.randrange(8, 60))) for _ in range(25)]

    def variant():
        s = set(rng.choice(families))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            s.symmetric_difference_update({rng.randrange(900)})
        return sorted(s)

    known = [(bytes([i]) if i % 7 else None, variant() if i % 9 else rng.choice([None, []])) for i in range(40)]
    arrivals = [(i, rng.choice([1, 2, 3, None]), bytes([rng.randrange(120)]) if rng.random() < 0.8 else None, variant() if rng.random() < 0.9 else rng.choice([None, []])) for i in range(90)]
    arrivals += [(1000 + i, 2, b"hot", families[0]) for i in range(30)]
    stored = spark.createDataFrame(known * 2, "exact_key binary, items array<bigint>")
    index = SetIndex.build(spark, stored, t, pivots=pivots)
    rows = spark.createDataFrame(arrivals, "seq long, batch int, exact_key binary, items array<bigint>")
    got = in_batches(rows, "batch", index).collect()
    assert len(got) == len({r.seq for r in got})
    assert {r.seq: r.verdict for r in got} == brute_sets(known, arrivals, t)
    index.close(delete=True)
    at_once = in_order(rows, "batch", SetIndex.build(spark, stored, t, pivots=pivots)).collect()
    assert sorted(map(tuple, at_once)) == sorted(map(tuple, got))


def test_empty_store_and_empty_batch(spark):
    empty = spark.createDataFrame([], "exact_key binary, items array<bigint>")
    index = SetIndex.build(spark, empty, Threshold(9, 10, False))
    none = spark.createDataFrame([], "seq long, batch int, exact_key binary, items array<bigint>")
    assert spark.read.parquet(index.check(none)).count() == 0
    index = SetIndex.open(spark, index.folder)
    rows = spark.createDataFrame([(1, b"a", [1, 2]), (2, None, [1, 2]), (3, b"a", None), (4, None, None), (5, None, [])], "seq long, exact_key binary, items array<bigint>")
    assert {(r.seq, r.verdict) for r in in_batches(rows.withColumn("batch", F.lit(1)), "batch", index).collect()} == {(2, "near"), (3, "exact")}
    assert in_batches(rows.withColumn("batch", F.lit(1)).where("false"), "batch", index).count() == 0


def test_mixtures_against_brute_force(spark):
    rng = random.Random(4)
    fraction = lambda: rng.choice([None, round(rng.uniform(0, 0.4), 2), 0.5, 1.0])
    mixture = lambda: (m := rng.choice(["a", "a;b", "b;c;d"]), [fraction() for _ in m.split(";")])
    known = [mixture() for _ in range(30)]
    arrivals = [(i, rng.choice([1, 2]), *mixture()) for i in range(150)] + [(900, 1, "", []), (901, 1, None, None)]
    index = MixtureIndex.build(spark, spark.createDataFrame(known, "mixture string, fractions array<double>"), 0.045)
    got = {r.seq: r.verdict for r in in_batches(spark.createDataFrame(arrivals, "seq long, batch int, mixture string, fractions array<double>"), "batch", index).collect()}
    near = lambda x, y: all((a is None and b is None) or (a is not None and b is not None and abs(a - b) < 0.045) for a, b in zip(x, y, strict=True))
    want, held = {}, list(known)
    for seq, _, m, f in sorted(arrivals, key=lambda a: (a[1], a[0])):
        if not m:
            continue
        same = [g for k, g in held if k == m]
        if f in same:
            want[seq] = "exact"
        elif any(near(f, g) for g in same):
            want[seq] = "near"
        else:
            held.append((m, f))
    assert got == want


def test_chain_is_settled_in_order(spark):
    n = 6  # each is near the one before it only: every second one is accepted
    rows = [(i, False, [f"k{i}"], [f"k{j}" for j in (i - 1, i, i + 1)]) for i in range(n)]
    batch = spark.createDataFrame(rows, "seq long, refused boolean, own array<string>, looks array<string>")
    assert {r.seq: r.accepted for r in settle(batch)[0].collect()} == {i: i % 2 == 0 for i in range(n)}


def test_a_batch_reads_what_it_probes(spark):
    """Twice the history, in other cells: the same files are read for a batch, and few more rows."""
    rng = random.Random(2)
    near = lambda base, n: [sorted(rng.sample(range(base, base + 60), 30)) for _ in range(n)]
    known = [s for base in (0, 1000, 2000, 3000) for s in near(base, 100)]
    schema = "seq long, exact_key binary, items array<bigint>"
    index = SetIndex.build(spark, spark.createDataFrame([(None, s) for s in known], "exact_key binary, items array<bigint>"), Threshold(9, 10, False), pivots=64, buckets=64)
    read = []
    for more in ([], near(2000, 200) + near(3000, 200)):
        if more:
            index.check(spark.createDataFrame([(i, None, s) for i, s in enumerate(more)], schema))
            index = SetIndex.open(spark, index.folder)
        rows = index.cells.rows
        index.cells.rows = lambda zones=None, rows=rows: read.append((sorted(zones), rows(zones).count())) or rows(zones)
        got = spark.read.parquet(index.check(spark.createDataFrame([(i, None, s) for i, s in enumerate(known[:2])], schema))).collect()
        assert {(r.seq, r.accepted) for r in got} == {(0, False), (1, False)}
    del read[1]  # of the new history itself
    assert read[0][0] == read[1][0] and len(read[0][0]) < 40
    assert read[1][1] - read[0][1] < 0.7 * 400 and read[0][1] < 0.7 * 400
    assert index.cells.rows(list(range(64))).count() >= 790
