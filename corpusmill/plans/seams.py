"""Queries of the injectable seams: embedders, rerank passages, replay of synonyms, agent results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import agent, embedding, evaluation, expansion, ranking, selection, synonyms
from corpusmill.plans.blocks import BEST_PER_ARTIFACT, CORPUS, QUERIES as ASK, bm25_sql, corpus, hashed_sql, passages
from corpusmill.plans.evaluation import _documents, _qrels
from corpusmill.plans.graph import LEDGER
from corpusmill.plans.ranking import _JOINED, _disclosed


def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of hashed terms of the records, as sparse rows."""
    out = embedding.hashed(corpus(spark, sf_dir), "record_id", "text", 64)
    return out.select("record_id", "bucket", F.round("weight", 9).alias("weight"))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as array columns: length and norm of each."""
    v = embedding.dense_column(embedding.hashed(corpus(spark, sf_dir), "record_id", "text", 64), "record_id", 64)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("record_id", F.size("vector").alias("dim"), F.round(norm, 4).alias("norm"))


def model_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected model in Arrow batches: letter counts of each text."""

    def model():
        def encode(texts: list[str]) -> np.ndarray:
            return np.array([[t.count(c) for c in "aeiou"] for t in texts], np.float32)

        return encode

    out = embedding.embed(corpus(spark, sf_dir).select("record_id", "text"), "text", model)
    return out.select("record_id", F.expr("transform(vector, x -> cast(x as bigint))").getItem(0).alias("n_a"), F.expr("cast(aggregate(vector, 0D, (a, x) -> a + x) as bigint)").alias("n_vowels"))


def rerank_artifact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages for a reranker that reads whole artifacts."""
    hits = ranking.bm25(corpus(spark, sf_dir), passages(spark, sf_dir), 2).select("qid", "record_id").join(corpus(spark, sf_dir), "record_id")
    out = expansion.passage_texts(hits, corpus(spark, sf_dir), "artifact")
    return out.select("qid", "record_id", F.length("passage").alias("n"))


def agent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = agent.make_search(corpus(spark, sf_dir), filter={"source": {"$ne": "web"}}, mode="lexical", k=3)
    out = tool(passages(spark, sf_dir))
    return out.select("qid", F.size(F.from_json("result", "struct<hits:array<struct<artifact_id:string>>>")["hits"]).alias("n_hits"), F.get_json_object("result", "$.hits[0].artifact_id").alias("first_id"))


def synonym_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nDCG of the passages with and without each ledger entry, and the verdict."""
    entries, docs, qrels = synonyms.ledger(spark, LEDGER), _documents(spark, sf_dir), _qrels(spark, sf_dir)
    asked = passages(spark, sf_dir).select("qid", "text")
    base = evaluation.per_query(_named(ranking.bm25(docs, asked, 10)), qrels, 10).agg(F.avg("ndcg").alias("ndcg"))
    before = entries.select("entry").crossJoin(F.broadcast(base))
    after = None
    for entry in range(len(LEDGER)):  # a ledger is replayed entry by entry, each over the whole query batch
        variants = synonyms.expand_queries(asked, entries.where(F.col("entry") == entry)).withColumn("vq", F.col("qid") * 10 + F.col("variant"))
        hits = ranking.bm25(docs, variants.select(F.col("vq").alias("qid"), "text"), 10)
        merged = ranking.merge_variants(hits.withColumn("variant", F.col("qid") % 10).withColumn("qid", F.expr("qid DIV 10")))
        one = evaluation.per_query(_named(merged.where("rank <= 10")), qrels, 10).agg(F.avg("ndcg").alias("ndcg")).select(F.lit(entry).alias("entry"), "ndcg")
        after = one if after is None else after.unionByName(one)
    return synonyms.verdicts(before, after)


def _named(ranked: DataFrame) -> DataFrame:
    return ranked.withColumnRenamed("record_id", "artifact_id")


def chosen_by_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An injected selector: every second candidate of the first six."""
    ranked = ranking.top(_disclosed(spark, sf_dir), 6, ties=("source", "artifact_id"))
    return selection.by_callable(ranked, lambda qid, rows: [r[1] for r in rows[::2]])


QUERIES = {
    f.__name__: f for f in (hashed_vectors, dense_vectors, model_vectors, rerank_artifact_text, agent_search, synonym_replay, chosen_by_callable)
}

_VECTORS = f"WITH {CORPUS}, {ASK}, {hashed_sql(dim=64)}"

ORACLE_SQL = {
    "hashed_vectors": f"{_VECTORS} SELECT record_id, bucket::INT AS bucket, round(w, 9) AS weight FROM rv",
    "dense_vectors": f"{_VECTORS} SELECT record_id, 64 AS dim, 1.0::DOUBLE AS norm FROM rv GROUP BY record_id",
    "model_vectors": f"""WITH {CORPUS} SELECT record_id, (length(text) - length(replace(text, 'a', '')))::BIGINT AS n_a,
        (length(text) - length(regexp_replace(text, '[aeiou]', '', 'g')))::BIGINT AS n_vowels FROM corpus""",
    "rerank_artifact_text": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=2)}, seeds AS (SELECT l.qid, l.record_id AS seed_id, c.source, c.artifact_id FROM lexical l JOIN corpus c USING (record_id)),
        m AS (SELECT s.qid, s.seed_id, c.record_id, c.surface_kind, c.surface_index, c.text FROM seeds s JOIN corpus c USING (source, artifact_id)),
        l AS (SELECT *, row_number() OVER w AS n, lag(text) OVER w AS pt, lag(surface_kind) OVER w AS pk, lag(surface_index) OVER w AS pi FROM m WINDOW w AS (PARTITION BY qid, seed_id ORDER BY surface_index, record_id)),
        o AS (SELECT *, CASE WHEN pk = surface_kind AND surface_index = pi + 1 THEN coalesce(list_max(list_filter(range(8, least(length(pt), length(text)) + 1), lambda x: right(pt, x) = left(text, x))), 0) ELSE 0 END AS sh FROM l),
        p AS (SELECT qid, seed_id, string_agg(CASE WHEN n = 1 THEN text WHEN sh > 0 THEN substring(text, sh + 1) ELSE E'\\n\\n' || text END, '' ORDER BY n) AS passage FROM o GROUP BY qid, seed_id)
        SELECT qid, seed_id AS record_id, length(left(passage, 2000))::INT AS n FROM p""",
    "agent_search": f"""WITH {CORPUS}, {ASK}, pool AS (SELECT * FROM corpus WHERE source IS DISTINCT FROM 'web'), {bm25_sql("pool", 50)},
        r AS (SELECT * FROM {BEST_PER_ARTIFACT.format(hits=_JOINED.format(hits="lexical"))} WHERE rank <= 3)
        SELECT q.qid, count(r.qid)::INT AS n_hits, max(CASE WHEN r.rank = 1 THEN r.artifact_id END) AS first_id FROM queries q LEFT JOIN r USING (qid) GROUP BY q.qid""",
    "chosen_by_callable": """WITH b AS (SELECT qid, source, artifact_id, max(score) AS score FROM disclosures WHERE artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, artifact_id) AS rank FROM b) SELECT qid, artifact_id FROM r WHERE rank IN (1, 3, 5)""",
}
