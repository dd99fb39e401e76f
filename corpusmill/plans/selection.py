"""Queries of selection, discovery, disclosure and expansion.

The disclosure log serves as rankings: per query the best score of each artifact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import expansion, ranking, selection
from corpusmill.plans.blocks import CORPUS, QUERIES as ASK, bm25_sql, corpus, passages
from corpusmill.runtime import table

FLOORS = {"skills": 0.8, "tools": 0.9, "reports": 0.5, "packages": 0.95, "sessions": 0.6, "web": 0.7}


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "disclosures").where("artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy("qid", "source", "artifact_id").agg(F.max("score").alias("score"), F.max("pointer").alias("pointer"))
    return ranking.top(best, None, ties=("source", "artifact_id"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queries of the log, those whose hits are all unusable included."""
    return table(spark, sf_dir, "disclosures").select("qid").where("qid IS NOT NULL").distinct()


def select_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.conservative(_logged(spark, sf_dir), _asked(spark, sf_dir), min_score=0.9))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("min_ratio", F.round("min_ratio", 9))


def select_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rel_threshold(_logged(spark, sf_dir), 0.95).select("qid", "rank", "artifact_id")


def select_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.score_gap(_logged(spark, sf_dir), 0.8).select("qid", "rank", "artifact_id")


def select_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.abs_threshold(_logged(spark, sf_dir), 0.9).select("qid", "rank", "artifact_id")


def select_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_k(_logged(spark, sf_dir), 2).select("qid", "rank", "artifact_id")


def dedup_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.dedup_by(_logged(spark, sf_dir), "pointer").select("qid", "rank", "artifact_id", "pointer")


def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(selection.discover(_logged(spark, sf_dir), _asked(spark, sf_dir), dedup="pointer", max_k=5, rel=0.8))


def federated_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _logged(spark, sf_dir).drop("pointer", "rank").withColumn("pos", F.ascii("source"))
    return selection.federated(hits, _asked(spark, sf_dir), FLOORS)


def lexical_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = ranking.bm25(corpus(spark, sf_dir), passages(spark, sf_dir), 20).join(corpus(spark, sf_dir).select("record_id", "text"), "record_id")
    return selection.lexical_miss(hits, passages(spark, sf_dir), ["falls back", "never changes", "zzz"], top_hits=3)


def disclose_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each query with the body its pointer names."""
    hits = _logged(spark, sf_dir).where("rank = 1").select("qid", "source", "artifact_id", "pointer")
    rows = table(spark, sf_dir, "artifacts").where("raw IS NOT NULL")
    bodies = rows.groupBy(F.concat(F.lit("store/"), F.col("artifact_id")).alias("pointer")).agg(F.max("raw").alias("body"))
    out = selection.disclose(hits, bodies, "bundled")
    return out.select("qid", "source", "artifact_id", "pointer", F.sha2("body", 256).alias("digest"), "body_chars", "note")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.bm25(corpus(spark, sf_dir), passages(spark, sf_dir), 3).select("qid", "record_id")
    return found.join(corpus(spark, sf_dir), "record_id")


def expand_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.window_members(_hits(spark, sf_dir), corpus(spark, sf_dir)).select("qid", "seed_id", "record_id")


def expand_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.parent_members(_hits(spark, sf_dir), corpus(spark, sf_dir)).select("qid", "seed_id", "record_id", "surface_index")


def stitched_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = expansion.expand(_hits(spark, sf_dir), corpus(spark, sf_dir), "parent")
    return out.select("qid", "seed_id", F.sha2("passage", 256).alias("digest"), "record_ids", "n_records")


def torn_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expansion.dangling(table(spark, sf_dir, "ledger"), table(spark, sf_dir, "records"))


QUERIES = {
    f.__name__: f
    for f in (
        select_conservative, select_rel, select_gap, select_abs, select_topk, dedup_by, discover, federated_discover, lexical_miss, disclose_body, expand_window, expand_parent,
        stitched_passages, torn_ledger,
    )
}

_LOGGED = """best AS (SELECT qid, source, artifact_id, max(score) AS score, max(pointer) AS pointer FROM disclosures
    WHERE artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY qid, source, artifact_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, artifact_id)::INT AS rank FROM best),
asked AS (SELECT DISTINCT qid FROM disclosures WHERE qid IS NOT NULL)"""


def _conservative_sql(hits: str, max_k: int, rel: float, floor: str = "NULL::DOUBLE") -> str:
    return f"""m AS (SELECT *, first_value(score) OVER w AS top, CASE WHEN first_value(score) OVER w > 0 THEN score / first_value(score) OVER w END AS share FROM {hits} WINDOW w AS (PARTITION BY qid ORDER BY rank)),
s AS (SELECT *, max(CASE WHEN rank > 1 AND (share IS NULL OR share < {rel}) THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) = 0 AND rank <= {max_k} AS inn FROM m),
p AS (SELECT qid, count(*) AS n, max(top) AS top_score, count(*) FILTER (inn) AS k, coalesce(min(share) FILTER (inn), 1.0) AS min_ratio, string_agg(artifact_id, '|' ORDER BY rank) FILTER (inn) AS ids FROM s GROUP BY qid),
j AS (SELECT a.qid, coalesce(n, 0) AS n, top_score, k, min_ratio, ids, coalesce(top_score < {floor}, false) AS below FROM asked a LEFT JOIN p USING (qid)),
chosen AS (SELECT qid, CASE WHEN n = 0 OR below THEN '' ELSE ids END AS selected, n = 0 OR below AS abstained,
    CASE WHEN n = 0 THEN 'abstain:no_candidates' WHEN below THEN 'abstain:below_floor' WHEN top_score > 0 AND k < least(n, {max_k}) THEN 'rel_threshold' WHEN n = 1 THEN 'single'
         WHEN top_score <= 0 THEN 'nonpositive_top' WHEN n > {max_k} THEN 'max_k' ELSE 'exhausted' END AS reason,
    n AS n_candidates, CASE WHEN n = 0 OR below THEN 0 ELSE k END AS n_selected, top_score, round(CASE WHEN NOT (n = 0 OR below) THEN min_ratio END, 9) AS min_ratio FROM j)"""


_FLOOR = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FLOORS.items()) + " END"
_WHOLE = r"regexp_matches(lower({t}), '(?:^|[^\p{{L}}\p{{N}}_]){words}(?:$|[^\p{{L}}\p{{N}}_])')"
_TOP3 = f"{CORPUS}, {ASK}, {bm25_sql(fetch=3)}, seeds AS (SELECT l.qid, l.record_id AS seed_id, c.source, c.artifact_id, c.surface_kind, c.surface_index FROM lexical l JOIN corpus c USING (record_id))"
_TERMS = ("falls back", "never changes", "zzz")
_SAID = ", ".join(_WHOLE.format(t="c.text", words=t.replace(" ", r"\s+")) + f" AS h{k}" for k, t in enumerate(_TERMS))
_SEEN = ", ".join(f"max(h{k}::INT) AS a{k}, max((h{k} AND rank <= 3)::INT) AS t{k}" for k in range(len(_TERMS)))

ORACLE_SQL = {
    "select_conservative": f"WITH {_LOGGED}, {_conservative_sql('hits', 3, 0.9, '0.9')} SELECT * FROM chosen",
    "select_rel": f"""WITH {_LOGGED}, m AS (SELECT *, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS top FROM hits)
        SELECT qid, rank, artifact_id FROM m WHERE CASE WHEN top <= 0 THEN rank = 1 ELSE score >= 0.95::DOUBLE * top END""",
    "select_gap": f"""WITH {_LOGGED}, m AS (SELECT *, lag(score) OVER (PARTITION BY qid ORDER BY rank) AS last FROM hits),
        b AS (SELECT *, max(CASE WHEN last IS NOT NULL AND (last <= 0 OR score < 0.8::DOUBLE * last) THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS cut FROM m)
        SELECT qid, rank, artifact_id FROM b WHERE cut = 0""",
    "select_abs": f"WITH {_LOGGED} SELECT qid, rank, artifact_id FROM hits WHERE score >= 0.9::DOUBLE",
    "select_topk": f"WITH {_LOGGED} SELECT qid, rank, artifact_id FROM hits WHERE rank <= 2",
    "dedup_by": f"""WITH {_LOGGED}, d AS (SELECT *, row_number() OVER (PARTITION BY qid, pointer ORDER BY rank) AS n FROM hits)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank, artifact_id, pointer FROM d WHERE n = 1 OR pointer IS NULL""",
    "discover": f"""WITH {_LOGGED}, d AS (SELECT *, row_number() OVER (PARTITION BY qid, pointer ORDER BY rank) AS nth FROM hits),
        kept AS (SELECT * EXCLUDE (rank, nth), row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM d WHERE nth = 1 OR pointer IS NULL),
        {_conservative_sql("kept", 5, 0.8)} SELECT * FROM chosen""",
    "federated_discover": f"""WITH {_LOGGED}, tops AS (SELECT qid, source, max(score) AS top, {_FLOOR}::DOUBLE AS floor FROM best GROUP BY qid, source),
        gated AS (SELECT *, floor IS NULL OR top >= floor AS passes FROM tops),
        alive AS (SELECT b.* FROM best b JOIN gated g ON g.qid = b.qid AND g.source = b.source AND g.passes),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, artifact_id)::INT AS sr FROM alive),
        n1 AS (SELECT qid, count(DISTINCT source) AS ns FROM alive GROUP BY qid),
        f AS (SELECT r.qid, r.source, r.artifact_id, round(CASE WHEN ns = 1 THEN score ELSE 1.0::DOUBLE / (60 + sr) END, 9) AS score, sr, ascii(source) AS pos FROM ranked r JOIN n1 USING (qid)),
        merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, sr, pos, artifact_id)::INT AS rank FROM f),
        {_conservative_sql("merged", 3, 0.9)},
        per AS (SELECT qid, count(*) AS sources, count(*) FILTER (passes) AS ok, count(floor) AS floored FROM gated GROUP BY qid)
        SELECT c.qid, selected, abstained, CASE WHEN NOT abstained THEN reason WHEN sources IS NULL THEN 'abstain:no_candidates' WHEN ok = 0 AND floored = sources THEN 'abstain:all_sources_below_floor'
               WHEN ok = 0 THEN 'abstain:no_surviving_sources' END AS reason, n_candidates, n_selected FROM chosen c LEFT JOIN per USING (qid)""",
    "lexical_miss": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=20)}, x AS (SELECT l.qid, l.rank, {_SAID} FROM lexical l JOIN corpus c USING (record_id)),
        s AS (SELECT qid, count(*) AS n, {_SEEN} FROM x GROUP BY qid)
        SELECT q.qid, n IS NULL AS zero_hits, concat_ws(',', {", ".join(f"CASE WHEN coalesce(t{k}, 0) = 0 THEN '{t}' END" for k, t in enumerate(_TERMS))}) AS missing_required,
               concat_ws(',', {", ".join(f"CASE WHEN coalesce(a{k}, 0) = 0 THEN '{t}' END" for k, t in enumerate(_TERMS))}) AS missing_in_candidates FROM queries q LEFT JOIN s USING (qid)""",
    "disclose_body": f"""WITH {_LOGGED}, b AS (SELECT 'store/' || artifact_id AS pointer, max(raw) AS body FROM artifacts WHERE raw IS NOT NULL GROUP BY 1)
        SELECT h.qid, h.source, h.artifact_id, h.pointer, sha256(left(body, 20000)) AS digest, length(body)::INT AS body_chars,
               CASE WHEN h.pointer IS NOT NULL AND body IS NULL THEN 'pointer_unreadable' WHEN length(body) > 20000 THEN 'truncated' END AS note
        FROM hits h LEFT JOIN b USING (pointer) WHERE h.rank = 1""",
    "expand_window": f"""WITH {_TOP3}, placed AS (SELECT *, row_number() OVER (PARTITION BY source, artifact_id, surface_kind ORDER BY surface_index, record_id) AS place FROM corpus)
        SELECT s.qid, s.seed_id, n.record_id FROM seeds s JOIN placed a ON a.record_id = s.seed_id
        JOIN placed n ON n.source = a.source AND n.artifact_id = a.artifact_id AND n.surface_kind = a.surface_kind AND abs(n.place - a.place) <= 1""",
    "expand_parent": f"WITH {_TOP3} SELECT s.qid, s.seed_id, c.record_id, c.surface_index FROM seeds s JOIN corpus c USING (source, artifact_id)",
    "stitched_passages": f"""WITH {_TOP3}, m AS (SELECT s.qid, s.seed_id, c.record_id, c.surface_kind, c.surface_index, c.text FROM seeds s JOIN corpus c USING (source, artifact_id)),
        l AS (SELECT *, row_number() OVER w AS n, lag(text) OVER w AS pt, lag(surface_kind) OVER w AS pk, lag(surface_index) OVER w AS pi FROM m WINDOW w AS (PARTITION BY qid, seed_id ORDER BY surface_index, record_id)),
        o AS (SELECT *, CASE WHEN pk = surface_kind AND surface_index = pi + 1 THEN coalesce(list_max(list_filter(range(8, least(length(pt), length(text)) + 1), lambda x: right(pt, x) = left(text, x))), 0) ELSE 0 END AS sh FROM l),
        p AS (SELECT *, CASE WHEN n = 1 THEN text WHEN sh > 0 THEN substring(text, sh + 1) ELSE E'\\n\\n' || text END AS piece FROM o)
        SELECT qid, seed_id, sha256(string_agg(piece, '' ORDER BY n)) AS digest, string_agg(record_id, '|' ORDER BY n) AS record_ids, count(*) AS n_records FROM p GROUP BY qid, seed_id""",
    "torn_ledger": """SELECT DISTINCT source, artifact_id, record_id FROM (SELECT source, artifact_id, unnest(record_ids) AS record_id FROM ledger)
        WHERE record_id NOT IN (SELECT record_id FROM records WHERE record_id IS NOT NULL)""",
}
