"""Queries of the rankers, fusion, weights, boosts, collapse and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import filters, ranking, search
from corpusmill.operators.embedding import hashed
from corpusmill.plans.blocks import BEST_PER_ARTIFACT, CORPUS, QUERIES as ASK, VECTOR_DIM, bm25_sql, corpus, hashed_sql, passages, tokens_sql
from corpusmill.runtime import table

FETCH = 50
WEIGHTS = {"synopsis": 3.0, "capability": 2.0, "deps": 0.0}
LIBS = ["index", "search", "ranker"]


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(corpus(spark, sf_dir), passages(spark, sf_dir), mode="lexical").drop("text")


def lexical_filtered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics follow the filter: only chunks and synopses outside one source are counted and ranked."""
    spec = {"source": {"$ne": "packages"}, "granularity": {"$exists": True}}
    pool = filters.candidates(corpus(spark, sf_dir), spec, ["chunk", "synopsis"])
    return ranking.bm25(pool, passages(spark, sf_dir), 10)


def dense_hashed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, queries = corpus(spark, sf_dir), passages(spark, sf_dir)
    return ranking.sparse_cosine(hashed(records, "record_id", "text"), hashed(queries, "qid", "text"), 10)


def dense_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the vectors whose id is divisible by 20, against all vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    asked = rows.where("record_id % 20 = 0").select(F.col("record_id").alias("qid"), F.col("vector").alias("qvec"))
    return ranking.cosine(rows, asked, 10, VECTOR_DIM)


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records, queries = corpus(spark, sf_dir), passages(spark, sf_dir)
    dense = ranking.sparse_cosine(hashed(records, "record_id", "text"), hashed(queries, "qid", "text"), FETCH)
    return dense, ranking.bm25(records, queries, FETCH)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rrf(*_channels(spark, sf_dir)).where("rank <= 10")


def hybrid_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.blend(*_channels(spark, sf_dir)).where("rank <= 10")


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(corpus(spark, sf_dir), passages(spark, sf_dir)).drop("text")


def surface_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(corpus(spark, sf_dir), passages(spark, sf_dir), mode="lexical", surface_weights=WEIGHTS).drop("text")


def _with_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the distinct wanted words of its text as its dependencies."""
    records = corpus(spark, sf_dir)
    from corpusmill.functions.text import tokens

    return records.withColumn("deps", F.array_distinct(tokens(F.col("text"))))


def dep_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    boost = {"libs": LIBS, "weight": 2.0, "saturate": 2}
    return search.search(_with_deps(spark, sf_dir), passages(spark, sf_dir), mode="lexical", dep_boost=boost).drop("text")


def collapse_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.bm25(corpus(spark, sf_dir), passages(spark, sf_dir), FETCH).join(corpus(spark, sf_dir).drop("text", "granularity"), "record_id")
    return ranking.distinct_surfaces(hits).where("rank <= 10")


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(corpus(spark, sf_dir), passages(spark, sf_dir), mode="lexical", rerank=ranking.term_overlap, per_artifact=False).drop("text")


def multi_query_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage and its two halves: variants are demoted by a tenth and merged with the original."""
    q = passages(spark, sf_dir)
    half = F.expr("CAST(length(text) / 2 AS INT)")
    variants = q.select("qid", F.posexplode(F.array("text", F.left("text", half), F.expr("substring(text, CAST(length(text) / 2 AS INT) + 1)"))).alias("variant", "text"))
    named = variants.withColumn("vq", F.col("qid") * 10 + F.col("variant"))
    hits = ranking.bm25(corpus(spark, sf_dir), named.select(F.col("vq").alias("qid"), "text"), FETCH)
    back = hits.withColumn("variant", F.col("qid") % 10).withColumn("qid", F.expr("qid DIV 10"))
    return ranking.merge_variants(back, 0.9).where("rank <= 10")


def fuse_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse_hits(_disclosed(spark, sf_dir), weights={"skills": 2.0}, k=10)


def fuse_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse_hits(_disclosed(spark, sf_dir), identity="artifact_id", k=10)


def fuse_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse_hits(_disclosed(spark, sf_dir).where("source = 'skills'"), k=10)


def _disclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disclosure log as rankings per query and source: the best score of each artifact."""
    rows = table(spark, sf_dir, "disclosures").where("artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy("qid", "source", "artifact_id").agg(F.max("score").alias("score"))
    return best.withColumn("pos", F.ascii("source"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, lexical_filtered_stats, dense_hashed_topk, dense_batch_topk, hybrid_rrf, hybrid_blend, search_hybrid, surface_weighted, dep_boosted, collapse_best,
        rerank_overlap, multi_query_fanout, fuse_sources, fuse_identity, fuse_single,
    )
}

_ID = "source, artifact_id, surface_kind, surface_index"
_OUT = f"qid, rank, score, record_id, {_ID}"
_JOINED = "SELECT h.*, c.source, c.artifact_id, c.surface_kind, c.surface_index FROM {hits} h JOIN corpus c USING (record_id)"
_WEIGHT = "CASE surface_kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END"
_RRF = """both_ AS (SELECT qid, record_id, d.score AS ds, d.rank AS dr, l.score AS ls, l.rank AS lr FROM dense d FULL JOIN lexical l USING (qid, record_id)),
fused AS (SELECT qid, record_id, round(CASE WHEN qid IN (SELECT qid FROM lexical) THEN coalesce(1.0 / (60 + dr), 0) + coalesce(1.0 / (60 + lr), 0) ELSE ds END, 9)::DOUBLE AS score FROM both_),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id)::INT AS rank FROM fused)"""
_DISCLOSED = """disclosed AS (SELECT qid, source, artifact_id, max(score) AS score, ascii(source) AS pos FROM disclosures
    WHERE artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score){where} GROUP BY qid, source, artifact_id)"""


def _fuse_sql(key: str, weight: str = "1.0", where: str = "") -> str:
    return f"""WITH {_DISCLOSED.format(where=where)},
placed AS (SELECT *, {key} AS key, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, artifact_id) AS place FROM disclosed),
once AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY qid, source, key ORDER BY place) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY place)::INT AS source_rank FROM once),
mass AS (SELECT qid, key, sum({weight} / (60 + source_rank)) AS mass, string_agg(DISTINCT source, ',' ORDER BY source) AS fused_sources FROM ranked GROUP BY qid, key),
rep AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY qid, key ORDER BY source_rank, pos, source, artifact_id) = 1),
n AS (SELECT qid, count(DISTINCT source) AS n FROM disclosed GROUP BY qid),
rows_ AS (SELECT r.qid, r.source, r.artifact_id, round(CASE WHEN n.n = 1 THEN r.score ELSE m.mass END, 9) AS score, r.score AS source_score, r.source_rank, m.fused_sources, r.pos
          FROM rep r JOIN mass m USING (qid, key) JOIN n USING (qid))
SELECT qid, source, artifact_id, score, source_score, source_rank, fused_sources,
       row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_rank, pos, artifact_id)::INT AS rank FROM rows_ QUALIFY rank <= 10"""


ORACLE_SQL = {
    "lexical_topk": f"WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)} SELECT {_OUT} FROM {BEST_PER_ARTIFACT.format(hits=_JOINED.format(hits='lexical'))} WHERE rank <= 10",
    "lexical_filtered_stats": f"""WITH {CORPUS}, {ASK}, pool AS (SELECT * FROM corpus WHERE source IS DISTINCT FROM 'packages' AND granularity IS NOT NULL
        AND surface_kind IN ('chunk', 'synopsis')), {bm25_sql("pool", 10)} SELECT qid, record_id, score, rank FROM lexical""",
    "dense_hashed_topk": f"WITH {CORPUS}, {ASK}, {hashed_sql(fetch=10)} SELECT qid, record_id, score, rank FROM dense",
    "dense_batch_topk": """WITH s AS (SELECT q.vec_id AS qid, r.vec_id AS record_id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS score
        FROM embeddings r JOIN embeddings q ON q.vec_id % 20 = 0)
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id)::INT AS rank FROM s QUALIFY rank <= 10""",
    "hybrid_rrf": f"WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)}, {hashed_sql(fetch=50)}, {_RRF} SELECT qid, record_id, score, rank FROM hits WHERE rank <= 10",
    "hybrid_blend": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)}, {hashed_sql(fetch=50)},
        both_ AS (SELECT qid, record_id, coalesce(d.score, 0) AS ds, coalesce(d.rank, 1 << 30) AS dr, coalesce(l.score, 0) AS ls, coalesce(l.rank, 1 << 30) AS lr
                  FROM dense d FULL JOIN lexical l USING (qid, record_id)),
        b AS (SELECT *, round(CASE WHEN qid NOT IN (SELECT qid FROM lexical) THEN ds WHEN qid NOT IN (SELECT qid FROM dense) THEN ls ELSE 0.5 * ds + 0.5 * ls / (ls + 8.0) END, 9) AS score FROM both_)
        SELECT qid, record_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dr, lr, record_id)::INT AS rank FROM b QUALIFY rank <= 10""",
    "search_hybrid": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)}, {hashed_sql(fetch=50)}, {_RRF}, cut_ AS (SELECT * FROM hits WHERE rank <= 50)
        SELECT {_OUT} FROM {BEST_PER_ARTIFACT.format(hits=_JOINED.format(hits="cut_"))} WHERE rank <= 10""",
    "surface_weighted": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)}, j AS ({_JOINED.format(hits="lexical")}),
        w AS (SELECT * EXCLUDE (score, rank), round(score * {_WEIGHT}, 9)::DOUBLE AS score FROM j),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id)::INT AS rank FROM w)
        SELECT {_OUT} FROM {BEST_PER_ARTIFACT.format(hits="SELECT * FROM r WHERE rank <= 50")} WHERE rank <= 10""",
    "dep_boosted": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)},
        j AS (SELECT h.*, c.source, c.artifact_id, c.surface_kind, c.surface_index, len(list_intersect(list_distinct(list_transform({tokens_sql("c.text")}, lambda x: regexp_replace(x, '[-_.]+', '-', 'g'))), {LIBS!r})) AS n
              FROM lexical h JOIN corpus c USING (record_id)),
        w AS (SELECT * EXCLUDE (score, rank, n), round(score + 2.0 * least(n, 2) / 2.0, 9) AS score FROM j),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id)::INT AS rank FROM w)
        SELECT {_OUT} FROM {BEST_PER_ARTIFACT.format(hits="SELECT * FROM r")} WHERE rank <= 10""",
    "collapse_best": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)}, j AS ({_JOINED.format(hits="lexical")}),
        f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY qid, {_ID} ORDER BY score DESC, rank) = 1)
        SELECT qid, record_id, score, {_ID}, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f.rank)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, f.rank) <= 10""",
    "rerank_overlap": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=50)},
        j AS (SELECT h.qid, h.record_id, h.rank AS old, c.source, c.artifact_id, c.surface_kind, c.surface_index,
                     list_distinct({tokens_sql("q.text")}) AS asked, {tokens_sql("left(c.text, 2000)")} AS has
              FROM lexical h JOIN corpus c USING (record_id) JOIN queries q USING (qid)),
        s AS (SELECT *, round(CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, list_distinct(has)))::DOUBLE / len(asked) ELSE 0 END, 9) AS score FROM j)
        SELECT qid, record_id, score, {_ID}, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old)::INT AS rank FROM s QUALIFY rank <= 10""",
    "multi_query_fanout": f"""WITH {CORPUS}, {ASK},
        variants AS (SELECT qid * 10 AS qid, text FROM queries UNION ALL SELECT qid * 10 + 1, left(text, length(text) // 2) FROM queries
                     UNION ALL SELECT qid * 10 + 2, substring(text, length(text) // 2 + 1) FROM queries),
        {bm25_sql(fetch=50, queries="variants")},
        m AS (SELECT qid // 10 AS qid, record_id, round(max(CASE WHEN qid % 10 = 0 THEN score ELSE score - (1.0 - 0.9) * abs(score) END), 9) AS score FROM lexical GROUP BY ALL)
        SELECT qid, record_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id)::INT AS rank FROM m QUALIFY rank <= 10""",
    "fuse_sources": _fuse_sql("source || chr(31) || artifact_id", "CASE source WHEN 'skills' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"),
    "fuse_identity": _fuse_sql("artifact_id", "1.0::DOUBLE"),
    "fuse_single": _fuse_sql("source || chr(31) || artifact_id", "1.0::DOUBLE", " AND source = 'skills'"),
}
