"""Per-key aggregates that stay balanced when a few keys hold most rows.

Only algebraic aggregates (count, min, max, sum) are used, so every input
partition first folds its rows into one partial state per key in a spillable
hash table, and one compact state per (partition, key) is shuffled. A key that
holds a third of all rows therefore sends as many records to its reducer as any
other key: at most one per input partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitsieve.sources.tables import stored


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Identical rows once. The shuffle hashes the whole row, so no key can heat a partition."""
    return df.select(*columns).distinct()


def per_key(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, n_rows, n_items, first_item, last_item`` of each key.

    ``df`` must hold distinct (keys, item) rows plus any column that tells rows
    apart. ``n_rows`` counts rows, ``n_items`` counts distinct items: the second
    needs one more level, (keys, item), which spreads a hot key over all tasks.

    Defined results: a null in any key makes a group of its own (SQL grouping);
    a null item counts as a row, not as an item; an empty table gives no rows;
    other columns of ``df`` are ignored.
    """
    per_item = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("__rows"))
    return per_item.groupBy(*keys).agg(
        F.sum("__rows").alias("n_rows"),
        F.count(item).alias("n_items"),
        F.min(item).alias("first_item"),
        F.max(item).alias("last_item"),
    )


def heavy_keys(per_key_rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Rows of :func:`per_key` whose key holds at least ``share`` of all rows.

    Rows with a null key count in the total but their group is never returned.
    The per-key states are written once, so that the total is one number from them, not another pass over the data.
    """
    per_key_rows = stored(per_key_rows, "per-key")
    total = per_key_rows.agg(F.sum("n_rows").alias("__total"))
    out = per_key_rows.crossJoin(F.broadcast(total)).where(F.col("n_rows") >= F.lit(share) * F.col("__total"))
    for key in keys:
        out = out.where(F.col(key).isNotNull())
    return out.drop("__total")
