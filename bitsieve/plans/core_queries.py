"""Queries on the general data-preparation operators of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.operators import bad_rows, hot_keys
from bitsieve.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that can't be loaded, with its reason."""
    rows = bad_rows.parse_rows(table(spark, sf_dir, "upload_smi"), "raw", bad_rows.SMI_LINE, ["file_no", "line_no"], "line_no")
    return rows.where(F.col("reason").isNotNull()).select("file_no", "line_no", "reason").distinct()


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that load, each once."""
    rows = bad_rows.parse_rows(table(spark, sf_dir, "upload_smi"), "raw", bad_rows.SMI_LINE, ["file_no", "line_no"], "line_no")
    return rows.where(F.col("reason").isNull()).select("file_no", "line_no", "smi", "extension", "idx").distinct()


def _bucket_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hot_keys.distinct_rows(table(spark, sf_dir, "molecule_lsh"), "band", "key", "structure_id")
    return hot_keys.per_key(rows, ["band", "key"], "structure_id")


def _molecule_substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hot_keys.distinct_rows(table(spark, sf_dir, "substance_structure"), "id", "substance", "molecule", "non_organic", "molar_fraction", "mapping")
    return hot_keys.per_key(rows, ["molecule"], "substance")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that hold at least 2 % of their table's distinct rows."""
    bands = hot_keys.heavy_keys(_bucket_records(spark, sf_dir), ["band", "key"], 0.02)
    molecules = hot_keys.heavy_keys(_molecule_substances(spark, sf_dir), ["molecule"], 0.02)
    return bands.select(F.lit("molecule_lsh").alias("tab"), F.concat_ws(":", F.col("band").cast("string"), "key").alias("key_text")).unionAll(
        molecules.select(F.lit("substance_structure").alias("tab"), F.col("molecule").cast("string").alias("key_text"))
    )


def p5_bucket_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (band, key): how many records, the smallest and the largest id."""
    return _bucket_records(spark, sf_dir).where("key is not null and band is not null").select("band", "key", "n_items", "first_item", "last_item")


def p5_molecule_substances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per molecule: how many substances, the smallest and the largest id."""
    return _molecule_substances(spark, sf_dir).where("molecule is not null").select("molecule", "n_rows", "n_items", "first_item", "last_item")


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p5_found, p5_bucket_records, p5_molecule_substances)}

_SMILES = bad_rows.SMILES.replace("*+", "*")
_P3 = f"""
        WITH l AS (SELECT DISTINCT file_no, line_no, trim(coalesce(raw, ''), chr(32) || chr(9) || chr(10) || chr(13)) AS s FROM upload_smi),
        f AS (SELECT *, string_split(s, ' ') AS f FROM l),
        x AS (SELECT *, coalesce(f[2][1] = '|', false) AS has FROM f),
        p AS (SELECT *, f[1] AS a, CASE WHEN has THEN f[2] END AS ext, f[2 + has::INT] AS b FROM x),
        u AS (SELECT *, regexp_replace(a, '^"|"$', '', 'g') AS smi, regexp_replace(b, '^"|"$', '', 'g') AS i FROM p),
        g AS (SELECT *, regexp_extract_all(regexp_replace(regexp_replace(smi, '\\[[^\\]]*\\]', 'A', 'g'), '{"|".join(bad_rows.ORGANIC_ATOMS)}', 'A', 'g'), 'A|%[0-9][0-9]|[0-9]') AS tok,
                     string_split(regexp_replace(smi, '[^().]', '', 'g'), '') AS marks FROM u),
        r AS (SELECT *, CASE
            WHEN s = '' THEN 'empty'
            WHEN list_contains(f, '') OR len(f) > 2 + has::INT THEN 'columns'
            WHEN coalesce(NOT regexp_full_match(ext, '[|][^|]*[|]'), false) OR contains(a, '|') OR coalesce(contains(b, '|'), false)
              OR (contains(a, '"') AND NOT regexp_full_match(a, '"[^"]*"')) OR coalesce(contains(b, '"') AND NOT regexp_full_match(b, '"[^"]*"'), false) THEN 'quoting'
            WHEN coalesce(NOT regexp_full_match(i, '{bad_rows.SMI_LINE.second.pattern}'), false) THEN 'idx'
            WHEN NOT regexp_full_match(smi, '{_SMILES}')
              OR list_reduce(marks, lambda d, m: CASE WHEN d < 0 THEN d WHEN m = '(' THEN d + 1 WHEN m = ')' THEN d - 1 WHEN m = '.' AND d > 0 THEN -1 ELSE d END, 0) <> 0
              OR len(list_filter(list_distinct(list_transform(list_filter(tok, lambda t: t <> 'A'), lambda t: ltrim(t, '%')::INT)), lambda k: NOT regexp_full_match(
                   array_to_string(list_transform(list_filter(tok, lambda t: t = 'A' OR try_cast(ltrim(t, '%') AS INT) = k), lambda t: CASE WHEN t = 'A' THEN 'A' ELSE '#' END), ''), 'A*(#A+#A*)*'))) > 0
            THEN 'smiles' END AS reason FROM g)
        """
SQL = {
    "p3_found": _P3 + "SELECT file_no, line_no, reason FROM r WHERE reason IS NOT NULL",
    "p3_loaded": _P3 + "SELECT file_no, line_no, smi, ext AS extension, coalesce(i, line_no::VARCHAR) AS idx FROM r WHERE reason IS NULL",
    "p5_found": """
        WITH l AS (SELECT DISTINCT band, key, structure_id FROM molecule_lsh),
             s AS (SELECT DISTINCT * FROM substance_structure)
        SELECT 'molecule_lsh' AS tab, band || ':' || key AS key_text FROM l
        WHERE key IS NOT NULL AND band IS NOT NULL GROUP BY band, key HAVING count(*) >= 0.02 * (SELECT count(*) FROM l)
        UNION ALL
        SELECT 'substance_structure', molecule::VARCHAR FROM s
        WHERE molecule IS NOT NULL GROUP BY molecule HAVING count(*) >= 0.02 * (SELECT count(*) FROM s)""",
    "p5_bucket_records": """
        SELECT band, key, count(DISTINCT structure_id) AS n_items, min(structure_id) AS first_item, max(structure_id) AS last_item
        FROM molecule_lsh WHERE key IS NOT NULL AND band IS NOT NULL GROUP BY band, key""",
    "p5_molecule_substances": """
        WITH s AS (SELECT DISTINCT * FROM substance_structure WHERE molecule IS NOT NULL)
        SELECT molecule, count(*) AS n_rows, count(DISTINCT substance) AS n_items, min(substance) AS first_item, max(substance) AS last_item
        FROM s GROUP BY molecule""",
}
