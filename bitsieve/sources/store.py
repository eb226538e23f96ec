"""The stored tables of molecules, substances, reactions and condensed graphs; repeated rows once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitsieve.config import EngineConfig
from bitsieve.functions.graph_columns import CONDENSED, GRAPH
from bitsieve.functions.sets import bit_set
from bitsieve.operators import search
from bitsieve.sources.tables import stored, table

_INTS = T.ArrayType(T.IntegerType())
_PAIRS = T.ArrayType(T.StructType().add("from", "integer").add("to", "integer"))
SCHEMAS = {
    "molecule": T.StructType().add("id", "long"),
    "molecule_structure": T.StructType().add("id", "long").add("molecule", "long").add("signature", "binary").add("smiles", "string").add("fingerprint", _INTS)
    .add("fingerprint_len", "integer").add("is_canonic", "boolean").add("structure", GRAPH).add("fast_mapping", _INTS),
    "non_organic": T.StructType().add("id", "long").add("signature", "binary").add("smiles", "string").add("structure", GRAPH).add("fast_mapping", _INTS),
    "substance": T.StructType().add("id", "long").add("name", "string"),
    "substance_structure": T.StructType().add("id", "long").add("substance", "long").add("molecule", "long").add("non_organic", "long").add("molar_fraction", "double").add("mapping", _PAIRS),
    "reaction": T.StructType().add("id", "long").add("reaction_center", "string"),
    "reaction_substance": T.StructType().add("id", "long").add("reaction", "long").add("substance", "long").add("is_product", "boolean").add("mapping", _PAIRS),
    "cgr": T.StructType().add("id", "long").add("reaction", "long").add("cgrsmiles", "string").add("fingerprint", _INTS).add("fingerprint_len", "integer").add("structure", CONDENSED),
    "molecule_lsh": T.StructType().add("band", "integer").add("key", "string").add("structure_id", "long"),
    "cgr_lsh": T.StructType().add("band", "integer").add("key", "string").add("structure_id", "long"),
    "data_source": T.StructType().add("id", "long").add("name", "string"),
    "molecule_source": T.StructType().add("source", "long").add("molecule", "long"),
    "reaction_source": T.StructType().add("source", "long").add("reaction", "long"),
}


def initialise(spark: SparkSession, folder: str, config) -> None:
    """An empty store: every table with its schema, and the settings."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("error").parquet(f"{folder}/{name}.parquet")
    config.to_table(spark).write.mode("error").parquet(f"{folder}/config.parquet")


@dataclass(frozen=True)
class Store:
    """Views of one folder of tables. Only the columns a query uses are read."""

    spark: SparkSession
    folder: str

    def has(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def config(self) -> EngineConfig:
        """The settings kept beside the tables, or the defaults."""
        return EngineConfig.from_table(table(self.spark, self.folder, "config")) if self.has("config") else EngineConfig()

    def rows(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name).select(*columns).distinct()

    def structure_rows(self, *columns: str) -> DataFrame:
        """As :meth:`structures`, with rows that are repeated as often as they are: for blocks, which take each structure once."""
        rows = table(self.spark, self.folder, "molecule_structure").select(F.col("id").alias("structure"), "molecule", bit_set("fingerprint").alias("fp"), *columns)
        return rows.where("size(fp) > 0")

    def structures(self, *columns: str) -> DataFrame:
        """``structure, molecule, fp`` and other columns, of structures with bits; the length is that of the set."""
        return self.structure_rows(*columns).dropDuplicates(["structure"])

    def condensed(self, *columns: str) -> DataFrame:
        rows = table(self.spark, self.folder, "cgr").select(F.col("id").alias("cgr"), "reaction", bit_set("fingerprint").alias("fp"), *columns)
        return rows.where("size(fp) > 0").dropDuplicates(["cgr"])

    def molecule_lsh(self) -> DataFrame:
        return self.rows("molecule_lsh", "band", "key", "structure_id").where("key is not null and band is not null")

    def cgr_lsh(self) -> DataFrame:
        """The stored index of condensed graphs; one is built, once, where there is none."""
        if self.has("cgr_lsh"):
            return self.rows("cgr_lsh", "band", "key", "structure_id").where("key is not null and band is not null")
        return stored(search.lsh_index(self.condensed(), "cgr", self.config().cgrs), "cgr-lsh")

    def substance_molecules(self) -> DataFrame:
        return self.rows("substance_structure", "id", "substance", "molecule", "non_organic").select("substance", "molecule", "non_organic")

    def reaction_roles(self) -> DataFrame:
        return self.rows("reaction_substance", "id", "reaction", "substance", "is_product").select("reaction", "substance", "is_product")
