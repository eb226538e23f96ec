"""Keeps a similarity index up to date while structures stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from bitsieve.config import LshConfig
from bitsieve.functions.sets import bit_set
from bitsieve.operators import search


def append_to_index(structures: DataFrame, index_path: str, checkpoint: str, config: LshConfig | None = None) -> StreamingQuery:
    """Starts a query that adds the band keys of streamed rows ``id, fingerprint`` to the index at ``index_path``.

    Each micro-batch goes to a folder of its number, which a repeated batch overwrites: rows are there once
    even after a failure. Null and empty fingerprints have no keys. Read with :func:`index_rows`.
    """
    config = config or LshConfig()

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.select("id", bit_set("fingerprint").alias("fp")).where("size(fp) > 0").dropDuplicates(["id"])
        search.lsh_index(rows, "id", config).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return structures.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_rows(spark, index_path: str) -> DataFrame:
    """``band, key, structure_id`` of all batches; a structure that came in several batches once."""
    return spark.read.parquet(index_path).select("band", "key", F.col("structure_id")).distinct()
