"""From lines of text to stored rows: parsing, quarantine, deduplication by signature, ids."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitsieve.config import FingerprintConfig
from bitsieve.functions.graph_columns import parsed
from bitsieve.sources.tables import stored as stored_table


def smiles_lines(spark, path: str) -> DataFrame:
    """``file, line_no, raw`` of the .smi files under a path, plain or in zip archives; line numbers start at 0 in each file.

    Plain files are read in splits by any number of tasks; a split's lines are numbered in place, and the counts of the
    splits before it, one number each, give it its offset. A zip archive can't be split: its members are read one by one, by one task.
    """
    import io
    import zipfile

    def lines(pdfs):
        import pandas as pd

        for pdf in pdfs:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if not m.endswith("/")):
                        with z.open(member) as f:
                            at = 0
                            while part := f.readlines(1 << 20):
                                yield pd.DataFrame({"file": f"{name}/{member}", "line_no": range(at, at + len(part)), "raw": [x.decode("utf-8", "replace").removesuffix("\n") for x in part]})
                                at += len(part)

    zipped = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(lines, "file string, line_no long, raw string")
    text = spark.read.option("pathGlobFilter", "*.smi").option("lineSep", "\n").text(path)
    text = stored_table(text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw")), "lines")
    splits = text.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return text.join(splits, ["file", "start"]).select("file", (F.col("at") + F.col("shift")).alias("line_no"), "raw").unionByName(zipped)


def parsed_components(rows: DataFrame, smiles: str, keep: list[str], *, config: FingerprintConfig = FingerprintConfig(), max_radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, quarantine): one row per component of each parsed line; lines that are no molecule, with the error."""
    config = config if max_radius is None else replace(config, max_radius=max_radius)
    # Parsed once: components and quarantine both read the result.
    out = stored_table(rows.select(*keep, F.col(smiles).alias("__smiles")).withColumn("__p", parsed("__smiles", config)).drop("__smiles"), "parsed")
    good = out.where("__p.error is null").select(*keep, F.posexplode("__p.components").alias("component_no", "__c")).select(*keep, "component_no", "__c.*")
    return good, out.where("__p.error is not null").select(*keep, F.col("__p.error").alias("error"))


def dedup_upsert(new: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with the id its signature has in ``stored``, or a new one, and ``inserted``.

    Each new signature is inserted once, by the first row in ``order``; ids go on from the largest stored one in that
    order of first rows. Rows without signature are left out. New ids are given in parts of the hash
    of the signature, as many as the session has shuffle partitions, whose lengths add up to the offsets: no single task sees all new rows.
    """
    known = stored.where("signature is not null").groupBy("signature").agg(F.min("id").alias("__known"))
    rows = new.where("signature is not null").join(known, "signature", "left")
    fresh = rows.where("__known is null").groupBy("signature").agg(F.min(F.struct(*order)).alias("__first"))
    n_parts = max(64, int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = fresh.withColumn("__part", F.pmod(F.xxhash64("signature"), F.lit(n_parts)).cast("int"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    number = Window.partitionBy("__part").orderBy("__first", "signature")
    ids = parts.withColumn("__n", F.row_number().over(number)).join(offsets, "__part").crossJoin(F.broadcast(last))
    ids = ids.select("signature", "__first", (F.col("__last") + F.col("__offset") + F.col("__n")).alias("__new"))
    out = rows.join(ids, "signature", "left")
    return out.select(*(F.col(c) for c in new.columns), F.coalesce("__known", "__new").alias("stored_id"), (F.struct(*order) == F.col("__first")).alias("__ins")).withColumn(
        "inserted", F.coalesce("__ins", F.lit(False))
    ).drop("__ins")
