"""Bulk load: from lines to the rows of all tables of a store, in one plan per table, without a loop over records.

Lines are parsed in Arrow batches; what is no molecule or reaction goes to a quarantine with its error. Each component is looked up by its
signature among the stored and the new ones (one join), inserted once if it is new, and reused otherwise. A component
that is reused keeps, in the link from its substance, the mapping of the stored structure's atoms to its own: the atoms at equal places of
the two canonical texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitsieve.config import EngineConfig
from bitsieve.functions.graph_columns import parsed, parsed_reaction
from bitsieve.operators import ingest, search
from bitsieve.sources.store import SCHEMAS
from bitsieve.sources.tables import stored


@dataclass(frozen=True)
class Loaded:
    """New rows by table, and the lines that failed."""

    tables: dict[str, DataFrame]
    quarantine: DataFrame


def numbered(rows: DataFrame, order: list[str], last: int, name: str = "id") -> DataFrame:
    """``rows`` with ids from ``last`` + 1 on, in the order of their range partitions: no task sees all rows.

    ``order`` must tell all rows apart. Rows are sorted into ranges; the sizes of the ranges, one number per partition, give each its offset.
    """
    sized = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    sized = stored(sized, "ranges")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sized.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__offset"))
    at = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return sized.withColumn("__n", at).join(offsets, "__p").withColumn(name, F.col("__n") + F.col("__offset") + F.lit(last)).drop("__p", "__n", "__offset")


def _last(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def _shaped(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields))


def linked(parts: DataFrame, known: dict[str, DataFrame], order: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(new rows of molecule, molecule_structure and non_organic; ``parts`` with ``molecule, non_organic, mapping``).

    ``parts`` has ``signature, smiles, fingerprint, organic, structure, fast_mapping`` and ``order``, which tells its rows apart; ``known`` has the stored
    ``molecule``, ``molecule_structure`` and ``non_organic``. A signature that is stored is reused, whether canonic or not; a new one is inserted by
    the first row in ``order``, the others reuse it. Reuse sets ``mapping``: atoms of the stored structure to those of the part.
    """
    tables, links = {}, []
    zipped = lambda a, b: F.transform(F.arrays_zip(a.alias("from"), b.alias("to")), lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to")))
    for kind, name in ((True, "molecule_structure"), (False, "non_organic")):
        rows = stored(ingest.dedup_upsert(parts.where("organic" if kind else "not organic"), known[name].select("id", "signature"), order), "upsert")
        fresh = rows.where("inserted")
        made = fresh.withColumn("id", F.col("stored_id")).withColumn("is_canonic", F.lit(True)).withColumn("fingerprint_len", F.size("fingerprint"))
        if kind:
            new = made.select("id").withColumn("molecule", F.col("id") + F.lit(_last(known["molecule"]) - _last(known[name])))
            made = made.join(new, "id")
            tables["molecule"] = _shaped(new.select(F.col("molecule").alias("id")), "molecule")
        tables[name] = _shaped(made, name)
        target = known[name].unionByName(tables[name], allowMissingColumns=True).select(
            F.col("id").alias("stored_id"), (F.col("molecule") if kind else F.lit(None).cast("long")).alias("molecule"), (F.lit(None).cast("long") if kind else F.col("id")).alias("non_organic"), F.col("fast_mapping").alias("__stored")
        )
        target = target.dropDuplicates(["stored_id"])
        out = rows.join(target, "stored_id")
        links.append(out.withColumn("mapping", F.when(~F.col("inserted") & F.col("__stored").isNotNull(), zipped(F.col("__stored"), F.col("fast_mapping")))).drop("__stored", "stored_id"))
    return tables, links[0].unionByName(links[1])


def load_substances(lines: DataFrame, smiles: str, order: list[str], known: dict[str, DataFrame], *, name: str | None = None, config: EngineConfig = EngineConfig()) -> Loaded:
    """Each line is a substance of its dot-separated parts, without fractions.

    ``order`` tells lines apart and gives the order of ids; ``known`` has the stored tables (empty ones for a new store).
    """
    keep = [*order, *([name] if name else [])]
    good, bad = ingest.parsed_components(lines, smiles, keep, config=config.fingerprint)
    good = stored(good, "components")
    tables, links = linked(good, known, [*order, "component_no"])
    substances = numbered(good.select(*keep).distinct(), order, _last(known["substance"]))
    tables["substance"] = _shaped(substances.withColumn("name", F.col(name) if name else F.lit(None).cast("string")), "substance")
    links = links.drop(*([name] if name else [])).join(substances.select(*order, F.col("id").alias("substance")), order)
    tables["substance_structure"] = _shaped(numbered(links.drop("id"), [*order, "component_no"], _last(known["substance_structure"])), "substance_structure")
    return Loaded(tables, bad)


def load_reactions(lines: DataFrame, smiles: str, order: list[str], known: dict[str, DataFrame], *, keep_cgr: bool = True, config: EngineConfig = EngineConfig()) -> Loaded:
    """Each line is a reaction: its centre, one substance per component with its role, and its condensed graph with ``keep_cgr``.

    A reaction whose sides can't be laid over each other has no centre and no condensed graph. Components that aren't connected or aren't readable send the
    line to the quarantine.
    """
    out = lines.select(*order, F.col(smiles).alias("__smiles")).withColumn("__p", parsed_reaction("__smiles", config.fingerprint))
    out = stored(out.select(*order, "__p.*"), "reactions")
    good = out.where("error is null")
    reactions = numbered(good.select(*order, "centre", "cgrsmiles", "fingerprint", "structure"), order, _last(known["reaction"]))
    tables = {"reaction": _shaped(reactions.withColumn("reaction_center", F.col("centre")), "reaction")}
    if keep_cgr:
        made = reactions.where("cgrsmiles is not null").withColumnRenamed("id", "reaction").withColumn("fingerprint_len", F.size("fingerprint"))
        tables["cgr"] = _shaped(numbered(made, ["reaction"], _last(known["cgr"])), "cgr")
    parts = good.select(*order, F.posexplode("components").alias("component_no", "__c")).select(*order, "component_no", "__c.*")
    more, links = linked(parts, known, [*order, "component_no"])
    tables |= more
    each = numbered(links, [*order, "component_no"], _last(known["substance"]), "substance")
    tables["substance"] = _shaped(each.select(F.col("substance").alias("id")), "substance")
    shift = lambda name: F.col("substance") - F.lit(_last(known["substance"])) + F.lit(_last(known[name]))
    tables["substance_structure"] = _shaped(each.withColumn("id", shift("substance_structure")), "substance_structure")
    own = each.drop("mapping").join(reactions.select(*order, F.col("id").alias("reaction")), order)
    # Atoms of the substance as it is read back to the atoms of the reaction: they keep the numbers of the line.
    tables["reaction_substance"] = _shaped(own.withColumn("id", shift("reaction_substance")), "reaction_substance")
    return Loaded(tables, out.where("error is not null").select(*order, "error"))


def append(loaded: Loaded, spark: SparkSession, folder: str, config: EngineConfig = EngineConfig()) -> None:
    """Writes the new rows to the tables of the store in ``folder``, and the band keys of new structures and condensed graphs to its indexes."""
    made = {name: stored(df, name) for name, df in loaded.tables.items()}  # all are made before any table changes
    for name, df in made.items():
        df.write.mode("append").parquet(f"{folder}/{name}.parquet")
    for source, index, settings in (("molecule_structure", "molecule_lsh", config.molecules), ("cgr", "cgr_lsh", config.cgrs)):
        if source in made:
            rows = made[source].select("id", F.col("fingerprint").alias("fp"))
            _shaped(search.lsh_index(rows, "id", settings), index).write.mode("append").parquet(f"{folder}/{index}.parquet")


def rebuild_index(spark: SparkSession, folder: str, source: str, index: str, config) -> None:
    """The whole similarity index of a stored table, written anew; rows with fewer than one bit have no keys."""
    from bitsieve.functions.sets import bit_set

    rows = spark.read.parquet(f"{folder}/{source}.parquet").select("id", bit_set("fingerprint").alias("fp")).where("size(fp) > 0").dropDuplicates(["id"])
    _shaped(search.lsh_index(rows, "id", config), index).write.mode("overwrite").parquet(f"{folder}/{index}.parquet")


def tables_of(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in SCHEMAS.items()}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def compatible(structure: str, canonic: str) -> Column:
    """A further structure of a molecule has the atoms of its canonic one: equal (number, element, isotope); null without either."""
    atoms = lambda c: F.array_sort(F.transform(F.col(f"{c}.atoms"), lambda a: F.struct(a.n.alias("n"), a.symbol.alias("symbol"), F.coalesce(a.isotope, F.lit(0)).alias("isotope"))))
    return atoms(structure) == atoms(canonic)
