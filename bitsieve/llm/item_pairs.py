"""How often two items occur in one basket, and how much more often than chance.

Heavy-light decomposition. Items are counted first. Those in more than
``heavy_above`` baskets are heavy; since the counts add up to the number of
(basket, item) rows, there are at most rows / ``heavy_above`` of them, and the
threshold is raised until at most ``max_heavy`` are left.

* heavy x heavy: baskets are numbered within blocks of a fixed number; a block is a bit
  matrix (a row of bits per heavy item), and the pair counts are popcounts of ANDed rows.
* light x light: pairs inside a basket are hash-counted (map-side combined).
* heavy x light: each light item's basket list is probed against the basket's heavy items.

The three results are disjoint and their union is complete. Before that, items are dropped that
can't be in any pair asked for: ``n_ab <= min(n_a, n_b)``, hence ``n_a >= min_count``, and the
lift bound gives ``max(n_a, n_b) <= N / min_lift``. Both are exact. Baskets of many light items
are cut into chunks whose pairs of chunks are counted by separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.sources.tables import stored

#: Baskets per bit matrix, and items per chunk of a basket.
BLOCK = 1 << 15
CHUNK = 64


def _bit_matrix_counts(n_heavy: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by block: (block, slot in block, heavy number)."""
        total = np.zeros((n_heavy, n_heavy), np.int64)
        bits = np.zeros((n_heavy, BLOCK // 8), np.uint8)

        def add() -> None:
            words = bits.view(np.uint64)
            used = np.flatnonzero(words.any(axis=0))
            if not len(used):
                return
            rows = np.ascontiguousarray(words[:, used])
            for a in np.flatnonzero(rows.any(axis=1)):
                total[a, a + 1 :] += np.bitwise_count(rows[a] & rows[a + 1 :]).sum(axis=1, dtype=np.int64)
            bits[:] = 0

        now = None
        for batch in batches:
            block, slot, item = (batch.column(c).to_numpy() for c in ("block", "slot", "heavy"))
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
            for s, e in zip(starts, [*starts[1:], len(block)], strict=True):
                if block[s] != now:
                    add()
                    now = block[s]
                np.bitwise_or.at(bits, (item[s:e], slot[s:e] >> 3), (1 << (slot[s:e] & 7)).astype(np.uint8))
        add()
        a, b = np.nonzero(total)
        for s in range(0, len(a), 100_000):
            x, y = a[s : s + 100_000], b[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(total[x, y])], ["ha", "hb", "n"])

    return run


def item_pairs(
    rows: DataFrame,
    n_baskets: DataFrame,
    *,
    min_count: int = 1,
    min_lift: float = 0.0,
    heavy_above: int = 200,
    max_heavy: int = 1024,
) -> DataFrame:
    """``item_a, item_b, n_a, n_b, n_ab, lift`` of every pair with ``item_a < item_b``.

    ``rows`` holds ``basket, item`` (long, any orderable item); an item counts once in a basket;
    rows with a null in either are no item; other columns are not read. ``n_baskets`` is one
    row with the column ``n``, the number of all baskets, with or without items. Kept are pairs with
    ``n_ab >= min_count`` and ``n_ab * n >= min_lift * n_a * n_b``. Empty tables give no rows.
    """
    spark: SparkSession = rows.sparkSession
    # Both are written once: what follows reads the items again, never the baskets.
    base = stored(rows.select("basket", "item").where("basket is not null and item is not null").distinct(), "baskets")
    counts = base.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    total = n_baskets.select(F.col("n").cast("long").alias("__n"))
    able = counts.where(F.col("n_item") >= min_count)
    if min_lift > 0:
        able = able.crossJoin(F.broadcast(total)).where(F.col("n_item") * F.lit(min_lift) <= F.col("__n")).drop("__n")
    able = stored(able, "able")
    # Heavy items: at most max_heavy (a bound that holds for every input) reach the driver.
    heavy = able.where(F.col("n_item") > heavy_above).orderBy(F.desc("n_item"), "item").limit(max_heavy).collect()
    n_heavy = len(heavy)
    kinds = able.schema["item"].dataType.simpleString()
    heavy_table = spark.createDataFrame([(r.item, k) for k, r in enumerate(heavy)], f"item {kinds}, heavy int")
    kept = stored(base.join(able, "item").join(F.broadcast(heavy_table), "item", "left").select("basket", "item", "heavy"), "items")
    light = kept.where("heavy is null").select("basket", "item")

    # light x light. Baskets of more than CHUNK light items are split by a hash of the item into
    # chunks of about that size, and each pair of chunks is a row of its own.
    sized = light.join(light.groupBy("basket").agg(F.count(F.lit(1)).alias("m")), "basket").where("m > 1")
    small = sized.where(F.col("m") <= CHUNK).groupBy("basket").agg(F.collect_list("item").alias("x"))
    small = small.select("x", F.col("x").alias("y"), F.lit(True).alias("same"))
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    large = sized.where(F.col("m") > CHUNK).withColumn("c", F.pmod(F.xxhash64("item"), chunks).cast("int"))
    large = large.groupBy("basket", "c", chunks.alias("k")).agg(F.collect_list("item").alias("x"))
    left = large.select("basket", F.col("c").alias("i"), F.explode(F.sequence("c", F.col("k") - 1)).alias("j"), "x")
    right = large.select("basket", F.col("c").alias("j"), F.explode(F.sequence(F.lit(0), F.col("c"))).alias("i"), F.col("x").alias("y"))
    large = left.join(right, ["basket", "i", "j"]).select("x", "y", (F.col("i") == F.col("j")).alias("same"))
    one = small.unionAll(large).select(F.explode("x").alias("a"), "y", "same")
    pairs = one.select("a", F.explode(F.filter("y", lambda v: ~F.col("same") | (v > F.col("a")))).alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))
    found = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))

    if n_heavy:
        numbered = kept.where("heavy is not null").select("basket", "item", "heavy")
        # heavy x light: a light item's list of baskets probes the heavy items of these baskets.
        of_basket = numbered.groupBy("basket").agg(F.collect_list("item").alias("heavies"))
        mixed = (
            light.join(of_basket, "basket")
            .select("item", F.explode("heavies").alias("other"))
            .groupBy("item", "other")
            .agg(F.count(F.lit(1)).alias("n_ab"))
            .select(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b"), "n_ab")
        )
        # heavy x heavy: blocks of baskets by hash; within a block a basket gets the next free slot.
        spread = numbered.groupBy("basket").agg(F.collect_list("heavy").alias("heavies")).where(F.size("heavies") > 1)
        blocks = spread.mapInArrow(_slots, "block long, slot int, heavy int")
        dense = blocks.mapInArrow(_bit_matrix_counts(n_heavy), "ha int, hb int, n long").groupBy("ha", "hb").agg(F.sum("n").alias("n_ab"))
        names = heavy_table
        dense = (
            dense.join(F.broadcast(names.select(F.col("heavy").alias("ha"), F.col("item").alias("__x"))), "ha")
            .join(F.broadcast(names.select(F.col("heavy").alias("hb"), F.col("item").alias("__y"))), "hb")
            .select(F.least("__x", "__y").alias("item_a"), F.greatest("__x", "__y").alias("item_b"), "n_ab")
        )
        found = found.unionAll(mixed).unionAll(dense)

    found = found.where(F.col("n_ab") >= min_count)
    a = able.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = able.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    scored = found.join(a, "item_a").join(b, "item_b").crossJoin(F.broadcast(total))
    n_ab, chance = F.col("n_ab") * F.col("__n"), F.col("n_a") * F.col("n_b")
    return scored.where(n_ab >= F.lit(min_lift) * chance).select("item_a", "item_b", "n_a", "n_b", "n_ab", F.try_divide(n_ab, chance).alias("lift"))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a task's baskets one after another: block and slot within the block."""
    seen = 0
    for batch in batches:
        lists = batch.column("heavies")
        n = batch.num_rows
        lengths = np.diff(lists.offsets.to_numpy())
        number = np.repeat(np.arange(seen, seen + n), lengths)
        seen += n
        yield pa.RecordBatch.from_arrays(
            [pa.array(number // BLOCK), pa.array((number % BLOCK).astype(np.int32)), lists.flatten().cast(pa.int32())], ["block", "slot", "heavy"]
        )
