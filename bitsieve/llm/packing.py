"""Items packed into containers of fixed capacity with little space left: best-fit decreasing.

Only sizes matter for the packing, and there are at most ``capacity`` of them. So the sizes are counted in
parallel, best-fit decreasing runs on the counts (a segment tree over remaining capacities finds the
tightest open container in logarithmic time; runs of equal containers move together), and its plan,
whose length depends on the capacity and not on the number of items, is applied in parallel to
every item by its rank among the items of its size. The result is that of best-fit decreasing over
all items at once, wherever they lie.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitsieve.sources.tables import stored

#: Items of one size that are ranked by one task.
RANKED = 200_000


class CapacityTree:
    """Numbers of open containers by remaining capacity; finds the least capacity of at least s in O(log)."""

    def __init__(self, capacity: int):
        self.width = 1
        while self.width <= capacity:
            self.width *= 2
        self.count = [0] * (2 * self.width)

    def add(self, c: int, k: int) -> None:
        i = c + self.width
        while i:
            self.count[i] += k
            i //= 2

    def tightest(self, s: int) -> int | None:
        i = s + self.width
        if self.count[i]:
            return s
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, items per container, first container): items of that size from that rank on
    go to consecutive containers, so many to each, until the next entry of the size.

    An item just placed leaves its container the tightest one for the next item of its size if that still
    fits, so a container takes all the items of a size that fit before another is used.
    """
    tree, runs = CapacityTree(capacity), {}
    plan, containers = [], 0

    def put(c: int, first: int, k: int) -> None:
        if k and c:
            runs.setdefault(c, deque()).append((first, k))
            tree.add(c, k)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            c = tree.tightest(size)
            if c is None:
                each = capacity // size
                need = -(-left // each)
                first, k, c = containers, need, capacity
                containers += need
            else:
                first, k = runs[c].popleft()
                tree.add(c, -k)
                each = c // size
                need = -(-left // each)
                if need < k:
                    runs[c].appendleft((first + need, k - need))
                    tree.add(c, k - need)
                    k = need
            plan.append((size, rank, each, first))
            whole = min(k, left // each)
            put(c - each * size, first, whole)
            placed = whole * each
            if whole < k:  # the last container takes fewer
                put(c - (left - placed) * size, first + whole, 1)
                placed = left
            rank, left = rank + placed, left - placed
    return plan


def packed_containers(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``container, key, piece_no, piece_from, piece_size`` of every item.

    An item over ``capacity`` is split into pieces of the capacity and a rest; no other item is split.
    Defined results: items of size null, zero or less go nowhere; equal rows are items of their own;
    an empty table gives no rows; other columns aren't read.
    """
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("__key"), F.col(size).cast("long").alias("__size")).where("__size > 0")
    pieces = rows.select("__key", "__size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__size - 1) div {capacity}"))).alias("piece_no"))
    pieces = pieces.select("__key", "piece_no", (F.col("piece_no") * capacity).alias("piece_from"), F.least(F.lit(capacity), F.col("__size") - F.col("piece_no") * capacity).cast("int").alias("piece_size"))
    pieces = stored(pieces, "pieces")
    counts = {r.piece_size: r["count"] for r in pieces.groupBy("piece_size").count().collect()}  # at most capacity rows
    plan = best_fit_decreasing(counts, capacity)
    table = np.array([(s, r, e, f) for s, r, e, f in plan], np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = spark.sparkContext.broadcast((table, spans(table)))

    # Rank within a size: by parts of bounded length, whose lengths add up to each part's offset.
    parts = max(1, -(-max(counts.values(), default=1) // RANKED))
    part = F.pmod(F.xxhash64("__key", "piece_no"), F.lit(parts)).cast("int")
    parted = pieces.withColumn("__part", part)
    lengths = parted.groupBy("piece_size", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("piece_size").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("piece_size", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    order = Window.partitionBy("piece_size", "__part").orderBy("__key", "piece_no")
    ranked = parted.withColumn("__rank", F.row_number().over(order) - 1).join(offsets, ["piece_size", "__part"])
    ranked = ranked.select("__key", "piece_no", "piece_from", "piece_size", (F.col("__rank") + F.col("__offset")).alias("__rank"))
    kind = items.schema[key].dataType.simpleString()
    out = ranked.mapInArrow(_placed(sent), f"container long, __key {kind}, piece_no long, piece_from long, piece_size int")
    return out.withColumnRenamed("__key", key)


def spans(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the plan and where each one's entries begin."""
    return np.unique(table[:, 0], return_index=True)


def _placed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (sizes, begins) = sent.value
        # Entries are sorted by (size, first rank); each size's ranks are shifted past those of smaller sizes.
        ends = np.append(begins[1:], len(table))
        for batch in batches:
            size, rank = batch.column("piece_size").to_numpy().astype(np.int64), batch.column("__rank").to_numpy()
            container = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                k = np.searchsorted(sizes, s)
                own = table[begins[k] : ends[k]]
                at = np.flatnonzero(size == s)
                row = own[np.searchsorted(own[:, 1], rank[at], side="right") - 1]
                container[at] = row[:, 3] + (rank[at] - row[:, 1]) // row[:, 2]
            cols = {c: batch.column(c) for c in ("__key", "piece_no", "piece_from", "piece_size")}
            yield pa.RecordBatch.from_pydict({"container": pa.array(container)} | cols)

    return run
