"""Queries pN_ of the training-data operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm import item_pairs as items
from bitsieve.llm import arrivals, packing, set_pairs, subjects, term_counts, tokens
from bitsieve.llm.pivots import Threshold
from bitsieve.sources.tables import table


def _role_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket, item: a reaction and its substances in their roles, as substance * 2 + (1 for products)."""
    rows = table(spark, sf_dir, "reaction_substance").where("is_product is not null")
    return rows.select(F.col("reaction").alias("basket"), (F.col("substance") * 2 + F.col("is_product").cast("int")).alias("item"))


def _reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reaction").agg(F.count_distinct("id").alias("n"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of substances in roles that occur together at least 5 times and 10 times as often as by chance."""
    pairs = items.item_pairs(_role_items(spark, sf_dir), _reactions(spark, sf_dir), min_count=5, min_lift=10.0)
    sub = lambda c: F.floor(F.col(c) / 2).cast("long")
    role = lambda c: F.when(F.col(c) % 2 == 1, "P").otherwise("R")
    out = pairs.select(sub("item_a").alias("sub_a"), sub("item_b").alias("sub_b"), F.concat(role("item_a"), role("item_b")).alias("roles"))
    return out.where("sub_a < sub_b")


def _terms(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = table(spark, sf_dir, name)
    counts = term_counts.ngram_counts(term_counts.record_terms(source, "id", "fingerprint"), 1)
    marked = term_counts.term_marks(counts, source.agg(F.count_distinct("id").alias("n")), rare_below=3, common_above=0.3)
    return marked.select(F.lit(name).alias("tab"), F.col("term").alias("bit_no"), "occurrences", "records", "mark")


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every bit, with its mark."""
    return _terms(spark, sf_dir, "molecule_structure").unionAll(_terms(spark, sf_dir, "cgr"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits too rare or too common to be useful."""
    return p6_terms(spark, sf_dir).where("mark is not null").select("tab", "bit_no", "mark")


def p6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one to three words (parts between white space) of the pages that at least 3 pages hold, with those in over 30 % marked."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda w: w != "").alias("words"))
    counts = term_counts.ngram_counts(term_counts.record_terms(pages, "doc_id", "words"), 3).where("records >= 3")
    total = pages.agg(F.count_distinct("doc_id").alias("n"))
    mark = F.when(F.col("records") > 0.3 * F.col("n"), "common")
    return counts.crossJoin(F.broadcast(total)).select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("length"), "occurrences", "records", mark.alias("mark"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table that share more than 0.7 of the bits in either."""
    one = lambda name: set_pairs.similar_pairs(table(spark, sf_dir, name), "id", "fingerprint", Threshold(7, 10, strict=True)).select(
        F.lit(name).alias("tab"), "id_a", "id_b"
    )
    return one("molecule_structure").unionAll(one("cgr"))


def _sorted_set(column: str):
    return F.array_sort(F.array_distinct(F.filter(column, lambda v: v.isNotNull()))).cast("array<bigint>")


def _structure_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "molecule_structure").select(F.col("signature").alias("exact_key"), _sorted_set("fingerprint").alias("items"))
    index = arrivals.SetIndex.build(spark, known, Threshold(9, 10, strict=False))
    new = table(spark, sf_dir, "incoming_structure").where("incoming_id is not null")
    new = new.select(F.col("incoming_id").alias("seq"), "batch_no", F.col("signature").alias("exact_key"), _sorted_set("fingerprint").alias("items")).distinct()
    out = arrivals.in_order(new, "batch_no", index)
    index.close(delete=True)
    return out.select(F.lit("structure").alias("item"), F.col("seq").alias("incoming_id"), "verdict")


def _mixtures(rows: DataFrame, key: str) -> DataFrame:
    """key, mixture, fractions from key, component, fraction; a component listed twice counts once (the smallest fraction)."""
    one = rows.groupBy(key, "component").agg(F.min("fraction").alias("fraction"))
    parts = one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("component", "fraction"))).alias("parts"))
    return parts.select(key, F.array_join("parts.component", ";").alias("mixture"), F.col("parts.fraction").alias("fractions"))


def _substance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "substance_structure").select("id", "substance", "molecule", "non_organic", "molar_fraction").distinct()
    named = F.coalesce(F.concat(F.lit("m"), F.col("molecule").cast("string")), F.concat(F.lit("n"), F.col("non_organic").cast("string")), F.lit("?"))
    known = _mixtures(rows.select("substance", named.alias("component"), F.col("molar_fraction").alias("fraction")), "substance")
    index = arrivals.MixtureIndex.build(spark, known, 0.045)

    new = table(spark, sf_dir, "incoming_substance").where("incoming_id is not null").select("incoming_id", "batch_no", "components").distinct()
    parts = new.select("incoming_id", F.explode("components").alias("c")).select("incoming_id", F.col("c.signature").alias("signature"), F.col("c.molar_fraction").alias("fraction"))
    molecules = table(spark, sf_dir, "molecule_structure").groupBy("signature").agg(F.min("molecule").alias("molecule"))
    others = table(spark, sf_dir, "non_organic").groupBy("signature").agg(F.min("id").alias("non_organic"))
    stands_for = F.coalesce(F.concat(F.lit("m"), F.col("molecule").cast("string")), F.concat(F.lit("n"), F.col("non_organic").cast("string")), F.concat(F.lit("s"), F.hex("signature")), F.lit("?"))
    parts = parts.join(molecules, "signature", "left").join(others, "signature", "left").select("incoming_id", stands_for.alias("component"), "fraction")
    mixed = new.select(F.col("incoming_id").alias("seq"), "batch_no").join(_mixtures(parts, "incoming_id").withColumnRenamed("incoming_id", "seq"), "seq")
    out = arrivals.in_order(mixed, "batch_no", index)
    index.close(delete=True)
    return out.select(F.lit("substance").alias("item"), F.col("seq").alias("incoming_id"), "verdict")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that are known already, exactly or nearly, batch by batch."""
    return _structure_verdicts(spark, sf_dir).unionAll(_substance_verdicts(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every page."""
    return tokens.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, sized in tokens, in containers of 2,048 tokens."""
    sizes = tokens.encoded(table(spark, sf_dir, "documents"), "doc_id", "text", only_sizes=True)
    return packing.packed_containers(sizes, "doc_id", "n_tokens", 2048)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of the articles on each page."""
    areas = [r.subject for r in table(spark, sf_dir, "subject_area").select("subject").collect()]  # a fixed list of 8
    return subjects.page_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_label"), areas)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p4_found, p6_found, p6_terms, p6_ngrams, p7_ids, p8_containers, p9_found)}

SQL = {
    "p1_found": """
        WITH r AS (SELECT DISTINCT 'molecule_structure' AS tab, id, list_sort(list_distinct(fingerprint)) AS f FROM molecule_structure WHERE len(fingerprint) > 0
                   UNION ALL SELECT DISTINCT 'cgr', id, list_sort(list_distinct(fingerprint)) FROM cgr WHERE len(fingerprint) > 0),
             b AS (SELECT tab, id, len(f) AS n, unnest(f) AS bit FROM r)
        SELECT a.tab, a.id AS id_a, b.id AS id_b FROM b a JOIN b ON a.tab = b.tab AND a.bit = b.bit AND a.id < b.id
        GROUP BY a.tab, a.id, b.id, a.n, b.n HAVING count(*) * 10 > 7 * (a.n + b.n - count(*))""",
    "p2_found": """
        WITH i AS (SELECT DISTINCT reaction, substance, is_product FROM reaction_substance WHERE is_product IS NOT NULL AND reaction IS NOT NULL AND substance IS NOT NULL),
             c AS (SELECT substance, is_product, count(*) AS n FROM i GROUP BY ALL),
             p AS (SELECT a.substance AS sub_a, b.substance AS sub_b, a.is_product AS pa, b.is_product AS pb, count(*) AS n_ab
                   FROM i a JOIN i b ON a.reaction = b.reaction AND a.substance < b.substance GROUP BY ALL HAVING count(*) >= 5)
        SELECT sub_a, sub_b, CASE WHEN pa THEN 'P' ELSE 'R' END || CASE WHEN pb THEN 'P' ELSE 'R' END AS roles
        FROM p JOIN c ca ON ca.substance = sub_a AND ca.is_product = pa JOIN c cb ON cb.substance = sub_b AND cb.is_product = pb
        WHERE n_ab * (SELECT count(DISTINCT id) FROM reaction) >= 10 * ca.n * cb.n""",
    "p4_found": """
        WITH RECURSIVE
          s AS (SELECT *, row_number() OVER (ORDER BY batch_no NULLS LAST, id) AS i FROM (
                  SELECT DISTINCT incoming_id AS id, batch_no, signature AS sig, list_sort(list_distinct(fingerprint)) AS f FROM incoming_structure)),
          k AS (SELECT DISTINCT list_sort(list_distinct(fingerprint)) AS f FROM molecule_structure WHERE len(list_distinct(fingerprint)) > 0),
          kn AS (SELECT row_number() OVER () AS k, f FROM k), kb AS (SELECT k, len(f) AS m, unnest(f) AS bit FROM kn),
          sb AS (SELECT i, len(f) AS n, unnest(f) AS bit FROM s),
          s_near AS (SELECT DISTINCT i FROM (SELECT i FROM sb JOIN kb USING (bit) GROUP BY i, k, n, m HAVING count(*) * 10 >= 9 * (n + m - count(*)))),
          s_exact AS (SELECT DISTINCT i FROM s JOIN molecule_structure t ON t.signature = s.sig),
          s_link AS (SELECT a.i, b.i AS j FROM sb a JOIN sb b ON a.bit = b.bit AND b.i < a.i GROUP BY a.i, b.i, a.n, b.n HAVING count(*) * 10 >= 9 * (a.n + b.n - count(*))
                     UNION SELECT a.i, b.i FROM s a JOIN s b ON a.sig = b.sig AND b.i < a.i),
          s_all AS (SELECT i, i IN (FROM s_near) OR i IN (FROM s_exact) AS known, coalesce((SELECT list(j) FROM s_link l WHERE l.i = s.i), []) AS js FROM s),
          s_run AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc UNION ALL
                    SELECT a.i, CASE WHEN a.known OR list_has_any(a.js, r.acc) THEN r.acc ELSE list_append(r.acc, a.i) END FROM s_run r JOIN s_all a ON a.i = r.i + 1),
          s_acc AS (SELECT unnest(acc) AS i FROM (SELECT acc FROM s_run ORDER BY i DESC LIMIT 1)),
          sm AS (SELECT DISTINCT id, substance, coalesce('m' || molecule, 'n' || non_organic, '?') AS c, molar_fraction AS x FROM substance_structure),
          known AS (SELECT DISTINCT list(c ORDER BY c) AS cs, list(x ORDER BY c) AS xs FROM (SELECT substance, c, min(x) AS x FROM sm GROUP BY ALL) GROUP BY substance),
          ms AS (SELECT signature, min(molecule) AS molecule FROM molecule_structure GROUP BY signature), no AS (SELECT signature, min(id) AS id FROM non_organic GROUP BY signature),
          ic AS (SELECT incoming_id AS id, batch_no, unnest(components) AS c FROM (SELECT DISTINCT incoming_id, batch_no, components FROM incoming_substance)),
          im AS (SELECT ic.id, batch_no, coalesce('m' || molecule, 'n' || no.id, 's' || hex(ic.c.signature), '?') AS c, min(ic.c.molar_fraction) AS x
                 FROM ic LEFT JOIN ms ON ms.signature = ic.c.signature LEFT JOIN no ON no.signature = ic.c.signature GROUP BY ALL),
          m AS (SELECT *, row_number() OVER (ORDER BY batch_no NULLS LAST, id) AS i FROM (SELECT id, batch_no, list(c ORDER BY c) AS cs, list(x ORDER BY c) AS xs FROM im GROUP BY ALL)),
          m_known AS (SELECT i, bool_or(m.xs = k.xs) AS same FROM m JOIN known k ON k.cs = m.cs
                      WHERE len(list_filter(list_zip(m.xs, k.xs), lambda z: NOT coalesce(abs(z[1] - z[2]) < 0.045, z[1] IS NULL AND z[2] IS NULL))) = 0 GROUP BY i),
          m_link AS (SELECT a.i, b.i AS j, a.xs = b.xs AS same FROM m a JOIN m b ON a.cs = b.cs AND b.i < a.i
                     WHERE len(list_filter(list_zip(a.xs, b.xs), lambda z: NOT coalesce(abs(z[1] - z[2]) < 0.045, z[1] IS NULL AND z[2] IS NULL))) = 0),
          m_all AS (SELECT i, i IN (SELECT i FROM m_known) AS known, coalesce((SELECT list(j) FROM m_link l WHERE l.i = m.i), []) AS js FROM m),
          m_run AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc UNION ALL
                    SELECT a.i, CASE WHEN a.known OR list_has_any(a.js, r.acc) THEN r.acc ELSE list_append(r.acc, a.i) END FROM m_run r JOIN m_all a ON a.i = r.i + 1),
          m_acc AS (SELECT unnest(acc) AS i FROM (SELECT acc FROM m_run ORDER BY i DESC LIMIT 1))
        SELECT 'structure' AS item, id AS incoming_id, CASE WHEN i IN (FROM s_exact) OR EXISTS (SELECT 1 FROM s b JOIN s_acc USING (i) WHERE b.sig = s.sig AND b.i < s.i) THEN 'exact' ELSE 'near' END AS verdict
        FROM s WHERE i NOT IN (FROM s_acc)
        UNION ALL
        SELECT 'substance', id, CASE WHEN i IN (SELECT i FROM m_known WHERE same) OR EXISTS (SELECT 1 FROM m_link l JOIN m_acc c ON c.i = l.j WHERE l.i = m.i AND same) THEN 'exact' ELSE 'near' END
        FROM m WHERE i NOT IN (FROM m_acc)""",
    "p6_terms": (
        _P6 := """
        WITH r AS (SELECT DISTINCT 'molecule_structure' AS tab, id, fingerprint FROM molecule_structure
                   UNION ALL SELECT DISTINCT 'cgr', id, fingerprint FROM cgr),
             n AS (SELECT tab, count(DISTINCT id) AS n FROM r GROUP BY tab),
             b AS (SELECT tab, id, unnest(fingerprint) AS bit_no FROM r),
             c AS (SELECT tab, bit_no, count(*) AS occurrences, count(DISTINCT id) AS records FROM b WHERE bit_no IS NOT NULL GROUP BY ALL)
        SELECT tab, bit_no, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.3 * n THEN 'common' END AS mark
        FROM c JOIN n USING (tab)"""
    ),
    "p6_ngrams": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS w FROM documents),
             i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
             g AS (SELECT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM i, (VALUES (1), (2), (3)) t(n) WHERE i + n - 1 <= len(w))
        SELECT gram, n::INT AS length, count(*) AS occurrences, count(DISTINCT doc_id) AS records,
               CASE WHEN count(DISTINCT doc_id) > 0.3 * (SELECT count(DISTINCT doc_id) FROM documents) THEN 'common' END AS mark
        FROM g GROUP BY gram, n HAVING count(DISTINCT doc_id) >= 3""",
    "p6_found": f"SELECT tab, bit_no, mark FROM ({_P6}) WHERE mark IS NOT NULL",
}
