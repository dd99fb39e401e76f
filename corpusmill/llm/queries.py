"""The queries of the training-data problems and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import abuse, distinctive, leakage, markup, neighbours, splitting, tokenizing, topn
from corpusmill.runtime import table

# --- 1: splitting oversized items ----------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    surfaces = table(spark, sf_dir, "surfaces").select(F.lit("surface").alias("item"), F.col("surface_id").cast("string").alias("item_id"), "text")
    records = table(spark, sf_dir, "records").select(F.lit("record").alias("item"), F.col("record_id").alias("item_id"), "text")
    return surfaces.unionByName(records)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).select("item", "item_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(_items(spark, sf_dir), ["item", "item_id"])


# --- 2: distinctive terms ------------------------------------------------------------------------


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where("tf >= 2 AND df BETWEEN 2 AND 5").select("record_id", "term")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.distinctive_terms(table(spark, sf_dir, "records"))


def p2_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most telling terms of each record (a report)."""
    top = topn.top_n(p2_terms(spark, sf_dir), ["record_id"], "score", "term", 10)
    return top.select("record_id", "rank", "term", F.round("score", 6).alias("score"))


# --- 3: the best of every group ------------------------------------------------------------------


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "disclosures").where(F.col("artifact_id").isNotNull())
    rows = rows.select("source", "artifact_id", "surface_kind", "score", "disclosure_id")
    return topn.top_n(rows, ["source", "artifact_id", "surface_kind"], "score", "disclosure_id", 3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_ranked(spark, sf_dir).select("disclosure_id")


# --- 4: most similar vectors ---------------------------------------------------------------------

#: The cosine from which TESTDATA.md counts a pair; more similar rows rank first, so it prunes without loss.
NEAR = 0.95


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.nearest(table(spark, sf_dir, "records"), min_cosine=NEAR)
    a, b = F.least("record_id", "neighbour"), F.greatest("record_id", "neighbour")
    return rows.select(a.alias("record_id_a"), b.alias("record_id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every record, however far."""
    return neighbours.nearest(table(spark, sf_dir, "records"))


# --- 5: markup residue ---------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact's current raw and every surface's text, once; the site of a page is its source."""
    artifacts = table(spark, sf_dir, "artifacts").select(F.lit("artifact").alias("item"), "source", F.col("artifact_id").alias("item_id"), F.col("modified_at").alias("at"), F.col("raw").alias("text"))
    surfaces = table(spark, sf_dir, "surfaces").select(
        F.lit("surface").alias("item"), "source", F.col("surface_id").cast("string").alias("item_id"), F.lit(None).cast("timestamp").alias("at"), "text"
    )
    rows = artifacts.unionByName(surfaces).groupBy("item", "source", "item_id").agg(F.max(F.struct("at", "text")).alias("last"))
    return rows.select("item", "source", "item_id", F.col("last.text").alias("text"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markup.converted(_pages(spark, sf_dir), ["item", "source", "item_id"], "source", "text")
    return rows.select("item", "source", "item_id", F.concat_ws(",", "kinds").alias("kinds"), "clean")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_clean(spark, sf_dir).where("kinds <> ''").select("item", "source", "item_id")


def p5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a menu of their site around the documents' ids: the menu goes, what is a page's own stays."""
    menu = F.concat(F.lit("<div><ul><li>Start page of "), F.col("source"), F.lit("<li>All pages of this site</ul></div>"))
    pages = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id", F.concat(menu, F.lit("<h2>Page "), F.col("doc_id"), F.lit("</h2>")).alias("text"))
    rows = markup.converted(pages, ["source", "doc_id"], "source", "text")
    return rows.select("source", "doc_id", F.array_contains("kinds", "site_template").alias("had_menu"), "clean")


# --- 8: token ids --------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode(table(spark, sf_dir, "documents"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode_spans(table(spark, sf_dir, "documents"))


# --- 9: leaked evaluation texts ------------------------------------------------------------------


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).where(F.col("exact_run") >= leakage.MIN_RUN).select("doc_id", "item_id")


# --- 10: abusive content -------------------------------------------------------------------------


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf_dir, "documents")).select("doc_id", F.round("score", 6).alias("score"), "worst")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf_dir, "documents")).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents at or over the threshold, and mean score, per source."""
    documents = table(spark, sf_dir, "documents")
    scored = abuse.score_documents(documents).join(documents.select("doc_id", "source"), "doc_id")
    flagged = F.avg((F.col("score") >= abuse.THRESHOLD).cast("int"))
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.round(flagged, 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_terms, p2_top_terms, p3_found, p3_ranked, p4_found, p4_neighbours, p5_clean, p5_found, p5_templates, p8_ids, p8_spans, p9_found, p9_leaks, p10_found, p10_scores, p10_rates)}

_TERMS = r"""
WITH unique_records AS (SELECT record_id, any_value(text) AS text FROM records WHERE record_id IS NOT NULL GROUP BY record_id),
postings AS (SELECT record_id, term, count(*)::INT AS tf
             FROM (SELECT record_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM unique_records) GROUP BY ALL),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM unique_records)
SELECT p.record_id, p.term, p.tf, s.df, s.cf, -log2(s.df / n.n) + log2(1 - exp(-s.cf / n.n)) AS ridf
FROM postings p JOIN stats s USING (term) CROSS JOIN n"""

_RANKED = """
SELECT source, artifact_id, surface_kind, score, disclosure_id,
       row_number() OVER (PARTITION BY source, artifact_id, surface_kind ORDER BY score DESC, disclosure_id)::INT AS rank
FROM (SELECT DISTINCT source, artifact_id, surface_kind, score, disclosure_id FROM disclosures
      WHERE artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) QUALIFY rank <= 3"""

_GRAMS = r"""
SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 12), ' ') AS gram FROM (
    SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (
        SELECT {key}, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{{L}}\p{{N}}]+') AS w
        FROM {table}) WHERE len(w) >= 13)"""

_MARKED = " OR ".join(f"regexp_matches(text, '{pattern.replace(chr(39), chr(39) * 2)}')" for _, pattern in markup.CONSTRUCTS.values())

ORACLE_SQL = {
    "p5_found": f"""
WITH current_rows AS (SELECT 'artifact' AS item, source, artifact_id AS item_id, raw AS text FROM artifacts
                      QUALIFY row_number() OVER (PARTITION BY source, artifact_id ORDER BY modified_at DESC NULLS LAST, raw DESC NULLS LAST) = 1),
pages AS (SELECT * FROM current_rows UNION SELECT 'surface', source, surface_id::VARCHAR, text FROM surfaces)
SELECT DISTINCT item, source, item_id FROM pages WHERE {_MARKED}""",
    "p5_templates": """
SELECT source, doc_id, count(*) OVER (PARTITION BY source) >= 10 AS had_menu,
       CASE WHEN count(*) OVER (PARTITION BY source) >= 10 THEN '' ELSE '- Start page of ' || source || E'\n- All pages of this site\n\n' END || '## Page ' || doc_id AS clean
FROM documents WHERE source IS NOT NULL""",
    "p4_found": """
WITH good AS (SELECT record_id, any_value(vector)::DOUBLE[] AS v FROM records
              WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: x IS NULL OR isnan(x)))
                AND list_bool_or(list_transform(vector, lambda x: x <> 0)) GROUP BY record_id),
pairs AS (SELECT a.record_id AS x, b.record_id AS y, list_cosine_similarity(a.v, b.v) AS c
          FROM good a JOIN good b ON a.record_id <> b.record_id),
best AS (SELECT x, y, c FROM pairs QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS record_id_a, greatest(x, y) AS record_id_b FROM best WHERE c >= 0.95""",
    "p9_found": f"""
SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(key="doc_id", table="documents")}) d
JOIN ({_GRAMS.format(key="item_id", table="benchmark")}) b USING (gram)""",
    "p1_found": r"""
SELECT DISTINCT item, item_id FROM (
    SELECT 'surface' AS item, surface_id::VARCHAR AS item_id, text FROM surfaces UNION ALL
    SELECT 'record', record_id, text FROM records)
WHERE length(trim(text, E' \t\r\n')) > 1200""",
    "p2_found": f"SELECT record_id, term FROM ({_TERMS}) WHERE tf >= 2 AND df BETWEEN 2 AND 5",
    "p2_top_terms": f"""
SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY tf * ridf DESC, term)::INT AS rank, term, round(tf * ridf, 6) AS score
FROM ({_TERMS}) QUALIFY rank <= 10""",
    "p3_found": f"SELECT disclosure_id FROM ({_RANKED})",
    "p3_ranked": _RANKED,
}
