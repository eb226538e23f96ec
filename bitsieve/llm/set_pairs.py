"""All pairs of records whose sets of values overlap above a Jaccard threshold. Exact.

Partition and deletion, not pivots: at a threshold of 0.7 the triangle inequality lets a set differ from its
partner by so much that, measured on 111,000 sets, each had to be replicated to 717 of 4,096 pivot cells
(README; ``tests/llm/measure_pivots.py`` measures it). So the universe is dealt into G parts, frequent items evenly. Partners x, y
differ in at most D items, D following from their sizes, hence in any k = D // 2 + 1 parts there is one with a
distance |x_g - y_g| + |y_g - x_g| of at most one. The smaller set x is written to the cells of all its projections
and of all its projections less an item; the larger set y asks in k of its G parts only, and may choose
which: it leaves out the parts whose cells it expects to be fullest, by the frequencies of its own items. Pairs are joined within cells only.

Within a cell a pair first has to pass a bound on a 64-bit parity sketch (the
sketches of x and y differ in no more bits than the sets differ in items); what passes is
scored on the whole sets. Both bounds are lossless, and hash collisions only add candidates.

Sizes of y fall into classes, each twice as wide as the next smaller one, with a G of its own; x is written for the one or two classes
that its partners can be in. Of two sets of one size that of smaller hash takes the role ``x``. Equal sets are one class
of records; links are found between these and handed to the members afterwards. All joins are equi-joins on 64-bit keys that the
planner may split where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsieve.llm.pivots import Threshold
from bitsieve.sources.tables import stored

#: How many of the most frequent items are dealt evenly; the rest are dealt by hash.
DEALT = 4096
#: Parts beyond those the largest size of a class needs: what its largest sets may leave out.
SPARE = 1
#: Numbers of a block of (set, part) pairs worked on at a time.
CELL_BLOCK = 1 << 20


def parts_needed(m, t: Threshold):
    """Of how many parts at least one is at a distance of at most one, for sets of size m and partners no larger.

    The difference n + m - 2 least(n + m) grows with n, but for a step of rounding: the largest n or the one below decide.
    """
    m = np.asarray(m, np.int64)
    at = lambda s: s - 2 * t.least_shared(s)
    return np.maximum(np.maximum(at(2 * m), at(2 * m - 1)), 0) // 2 + 1


def size_classes(largest: int, t: Threshold) -> list[tuple[int, int, int]]:
    """(least size, largest size, G) of the classes of y, up to the largest set."""
    out = []
    while largest > 0:
        low = largest // 2 + 1
        out.append((low, largest, int(parts_needed(np.arange(low, largest + 1), t).max()) + SPARE))
        largest = low - 1
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(frequent: list[tuple[int, int]], n_sets: int, largest: int, t: Threshold):
    """Rows (role, cell, h, sketch, n) of each set, for all size classes it takes part in."""
    classes = size_classes(largest, t)
    by_rank = np.array([item for item, _ in frequent], np.int64)
    order = np.argsort(by_rank, kind="stable")
    known = by_rank[order]
    rare = np.log(max(n_sets, 1) / max(min((n for _, n in frequent), default=1), 1))
    worth = np.log(max(n_sets, 1) / np.array([n for _, n in frequent] or [1]))[order] if len(known) else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for s in range(0, batch.num_rows, 2000):
                    yield from emit(batch.slice(s, 2000))

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("items")
        offsets = lists.offsets.to_numpy()
        items = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        n = np.diff(offsets).astype(np.int64)
        first = offsets[:-1] - offsets[0]
        h, sketch = batch.column("h").to_numpy(), batch.column("sketch").to_numpy()
        value = mix(items + 0x51ED)
        rank, weight = np.full(len(items), -1), np.full(len(items), rare)
        if len(known):
            at = np.minimum(np.searchsorted(known, items), len(known) - 1)
            hit = known[at] == items
            rank, weight = np.where(hit, order[at], -1), np.where(hit, worth[at], rare)
        def rows(larger: bool, recs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(recs), larger)), pa.array(keys.view(np.int64)), pa.array(h[recs]), pa.array(sketch[recs]), pa.array(n[recs].astype(np.int32))],
                ["larger", "cell", "h", "sketch", "n"],
            )

        for number, (low, high, g) in enumerate(classes):
            near = np.flatnonzero((n <= high) & (t.least_shared(n + np.maximum(n, low)) <= n))
            step = max(1, CELL_BLOCK // g)
            for s in range(0, len(near), step):
                own = near[s : s + step]
                size = n[own]
                at = np.repeat(first[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                rec = np.repeat(np.arange(len(own)), size)
                turn = rank[at] % (2 * g)
                part = np.where(rank[at] >= 0, np.where(turn < g, turn, 2 * g - 1 - turn), (value[at] >> np.uint64(33)).astype(np.int64) % g)
                place = rec * g + part
                sums = np.zeros(len(own) * g, np.uint64)
                np.add.at(sums, place, value[at])
                # What a part tells, at worst: the weight of its items but the rarest.
                total, top = np.bincount(place, weight[at], len(own) * g), np.zeros(len(own) * g)
                np.maximum.at(top, place, weight[at])
                told = np.argsort((top - total).reshape(-1, g), axis=1, kind="stable")
                asked = np.zeros((len(own), g), bool)
                np.put_along_axis(asked, told, np.arange(g)[None, :] < np.where(size >= low, parts_needed(size, t), 0)[:, None], 1)
                asked = asked.ravel()
                salt = mix(np.arange(g, dtype=np.uint64) + np.uint64((number + 1) << 32))
                # Keys of two kinds: 0 meets full projections of y, 1 those of y less an item.
                key = lambda v, p, kind: mix(v ^ salt[p]) + np.uint64(kind)
                short = sums[place] - value[at]
                full, every = np.arange(len(sums)), np.tile(np.arange(g), len(own))
                yield rows(False, own[np.concatenate([full // g, full // g, rec])], np.concatenate([key(sums, every, 0), key(sums, every, 1), key(short, part, 0)]))
                full, less = full[asked], asked[place]
                yield rows(True, own[np.concatenate([full // g, rec[less]])], np.concatenate([key(sums[full], every[full], 0), key(short[less], part[less], 1)]))

    return run


def record_sets(df: DataFrame, record: str, values: str) -> DataFrame:
    """``id, items``: distinct non-null values in order; null and empty sets are left out, equal rows once."""
    items = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull()))).cast("array<bigint>")
    return df.select(F.col(record).alias("id"), items.alias("items")).where("id is not null and size(items) > 0").distinct()


def similar_classes(sets: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``id..., cls`` of every row of ``sets``, and ``cls_a, cls_b, shared, n_a, n_b`` between classes of equal sets.

    ``sets`` holds ``items`` (sorted, distinct longs, not empty) and any other columns.
    """
    digest = F.unhex(F.md5(F.concat_ws(",", F.col("items").cast("array<string>"))))
    members = sets.withColumn("cls", digest)
    classes = stored(
        members.groupBy("cls").agg(F.first("items").alias("items")).select("cls", F.xxhash64("items").alias("h"), "items", F.size("items").alias("n"), _sketch("items").alias("sketch")),
        "classes",
    )
    frequent = classes.select(F.explode("items").alias("item")).groupBy("item").count().orderBy(F.desc("count"), "item").limit(DEALT).collect()
    largest = classes.agg(F.max("n")).first()[0] or 1
    cells = classes.select("h", "sketch", "items").mapInArrow(_cells([(r["item"], r["count"]) for r in frequent], classes.count(), largest, t), "larger boolean, cell long, h long, sketch long, n int")
    x = cells.where("not larger").select("cell", F.col("h").alias("hx"), F.col("sketch").alias("sx"), F.col("n").alias("nx"))
    y = cells.where("larger").select("cell", F.col("h").alias("hy"), F.col("sketch").alias("sy"), F.col("n").alias("ny"))
    total = "(cast(nx + ny as bigint))"
    least = f"({t.p} * {total} div {t.p + t.q} + 1)" if t.strict else f"(({t.p} * {total} + {t.p + t.q - 1}) div {t.p + t.q})"
    near = f"bit_count(sx ^ sy) <= {total} - 2 * {least}"
    # The size of generated cells can't be estimated from the table: never broadcast them.
    met = x.join(y.hint("merge"), (x.cell == y.cell) & F.expr("(nx < ny or (nx = ny and hx < hy))") & F.expr(f"{least} <= nx") & F.expr(near))
    candidates = met.select("hx", "hy").distinct()
    # Equal hashes of different sets would be pairs that no two roles tell apart.
    clash = classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("hx"), F.col("h").alias("hy"))
    candidates = candidates.unionAll(clash)
    side = lambda s, h: classes.select(F.col("h").alias(h), *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "items", "n")))
    scored = candidates.join(side("a", "hx"), "hx").join(side("b", "hy"), "hy").where("hx <> hy or cls_a < cls_b")
    scored = scored.withColumn("shared", F.size(F.array_intersect("items_a", "items_b")))
    passes = F.expr(least.replace("nx", "n_a").replace("ny", "n_b") + " <= shared")
    return members, scored.where(passes).select("cls_a", "cls_b", "shared", "n_a", "n_b")


def _sketch(items: str) -> Column:
    """Parity of the set's items over 64 hashed bits."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(v), F.lit(64)).cast("int"))))


def similar_pairs(df: DataFrame, record: str, values: str, t: Threshold, other: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """``id_a, id_b, shared, n_a, n_b`` of every pair of records whose sets pass ``t``.

    Within one table ``id_a < id_b``; with ``other`` = (table, record, values) the pairs are between the two
    tables, ``id_a`` from the first. Defined results: values count once in a set; null and empty sets
    and null ids are in no pair; identical rows count once; empty tables give no rows; other
    columns are not read. All members of equal sets are paired.
    """
    sets = record_sets(df, record, values).withColumn("second", F.lit(False))
    if other:
        sets = sets.unionAll(record_sets(*other).withColumn("second", F.lit(True)))
    members, links = similar_classes(sets, t)
    members = stored(members.select("id", "cls", "second", F.size("items").alias("n")), "members")
    a = members.select(F.col("id").alias("id_a"), F.col("cls").alias("cls_a"), F.col("second").alias("second_a"), F.col("n").alias("n_first"))
    b = members.select(F.col("id").alias("id_b"), F.col("cls").alias("cls_b"), F.col("second").alias("second_b"))
    between = links.join(a.drop("n_first"), "cls_a").join(b, "cls_b")
    # Within a class only members of classes that have several are read again.
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("cls").alias("cls_a"))
    within = a.join(several, "cls_a", "left_semi").join(b, F.col("cls_a") == F.col("cls_b"))
    within = within.where("id_a < id_b or second_a <> second_b").withColumns({"shared": F.col("n_first"), "n_a": F.col("n_first"), "n_b": F.col("n_first")}).drop("n_first")
    both = between.select(*_PAIR).unionAll(within.select(*_PAIR))
    if other:
        swap = F.col("second_a")
        out = both.where("second_a <> second_b").select(
            F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"), F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("id_b"), "shared",
            F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        )
        return out.distinct()
    swap = F.col("id_a") > F.col("id_b")
    return both.where("id_a <> id_b").select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "shared",
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    )


_PAIR = ("id_a", "id_b", "second_a", "second_b", "shared", "n_a", "n_b")
