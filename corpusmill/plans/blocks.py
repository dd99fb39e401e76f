"""Inputs that many queries share, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import blank
from corpusmill.runtime import table

VECTOR_DIM = 64


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored records, once each, with text: the searchable corpus."""
    rows = table(spark, sf_dir, "records").where(~blank(F.col("text")) & F.col("record_id").isNotNull())
    last = rows.groupBy("record_id").agg(F.max(F.struct("ingested_at", "source", "artifact_id", "surface_kind", "surface_index", "granularity", "text")).alias("__b"))
    return last.select("record_id", "__b.source", "__b.artifact_id", "__b.surface_kind", "__b.surface_index", "__b.granularity", "__b.text")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as a query batch."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", "lang")


CORPUS = r"""corpus AS (
    SELECT record_id, any_value(source) AS source, any_value(artifact_id) AS artifact_id, any_value(surface_kind) AS surface_kind,
           any_value(surface_index) AS surface_index, any_value(granularity) AS granularity, any_value(text) AS text
    FROM records WHERE text IS NOT NULL AND trim(text, E' \t\r\n') <> '' AND record_id IS NOT NULL GROUP BY record_id)"""
QUERIES = "queries AS (SELECT item_id AS qid, text, lang FROM benchmark)"


def tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def bm25_sql(pool: str = "corpus", fetch: int | None = 10, queries: str = "queries", name: str = "lexical", prefix: str = "") -> str:
    """CTEs that end in ``name(qid, record_id, score, rank)``."""
    p = prefix
    cut = f" QUALIFY rank <= {fetch}" if fetch else ""
    return rf"""
{p}tok AS (SELECT record_id, len(t) AS dl, unnest(t) AS term FROM (SELECT record_id, {tokens_sql("text")} AS t FROM {pool})),
{p}size AS (SELECT count(*) AS n, avg(len({tokens_sql("text")})) AS avgdl FROM {pool}),
{p}post AS (SELECT record_id, term, count(*) AS tf, max(dl) AS dl FROM {p}tok GROUP BY ALL),
{p}freq AS (SELECT term, count(*) AS df FROM {p}post GROUP BY term),
{p}ask AS (SELECT DISTINCT qid, unnest({tokens_sql("text")}) AS term FROM {queries}),
{p}bm AS (SELECT a.qid, p.record_id, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))), 9) AS score
          FROM {p}ask a JOIN {p}post p USING (term) JOIN {p}freq f USING (term) CROSS JOIN {p}size s GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id)::INT AS rank FROM {p}bm{cut})"""


def hashed_sql(pool: str = "corpus", fetch: int | None = 10, queries: str = "queries", name: str = "dense", dim: int = 512, prefix: str = "") -> str:
    """CTEs of the hashed-term cosine that end in ``name(qid, record_id, score, rank)``."""
    p = prefix
    cut = f" QUALIFY rank <= {fetch}" if fetch else ""

    def vector(of: str, key: str, alias: str) -> str:
        return f"""
{p}{alias}0 AS (SELECT {key}, ('0x' || left(sha256(term), 8))::BIGINT % {dim} AS bucket, count(*) AS n
        FROM (SELECT {key}, unnest({tokens_sql("text")}) AS term FROM {of}) GROUP BY ALL),
{p}{alias} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})::DOUBLE) AS w FROM {p}{alias}0)"""

    return f"""{vector(pool, "record_id", "rv")},{vector(queries, "qid", "qv")},
{p}cs AS (SELECT q.qid, r.record_id, round(sum(q.w * r.w), 9) AS score FROM {p}rv r JOIN {p}qv q USING (bucket) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id)::INT AS rank FROM {p}cs{cut})"""


BEST_PER_ARTIFACT = """(
    SELECT * EXCLUDE (rank, f), row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank)::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY qid, source, artifact_id ORDER BY score DESC, rank) AS f FROM ({hits})) WHERE f = 1)"""
