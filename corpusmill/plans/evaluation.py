"""Queries of evaluation and calibration.

Corpus: the documents. Queries: the benchmark passages. Gold: the documents that hold the first or the last
``HELD`` words of a passage; passages that none holds are abstention cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as ev
from corpusmill.operators import ranking
from corpusmill.functions.text import tokens
from corpusmill.operators.embedding import hashed
from corpusmill.plans.blocks import QUERIES as ASK, bm25_sql, hashed_sql, passages, tokens_sql
from corpusmill.runtime import table

K, HELD = 10, 13
#: So many ends of passages are broadcast to the documents.
ENDS = 200_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL AND btrim(text) <> ''").select(F.col("doc_id").alias("record_id"), "text")


def _ranked(spark: SparkSession, sf_dir: str, fetch: int = K) -> DataFrame:
    return ranking.bm25(_documents(spark, sf_dir), passages(spark, sf_dir), fetch).withColumnRenamed("record_id", "artifact_id")


def _dense(spark: SparkSession, sf_dir: str, fetch: int = K) -> DataFrame:
    r = ranking.sparse_cosine(hashed(_documents(spark, sf_dir), "record_id", "text"), hashed(passages(spark, sf_dir), "qid", "text"), fetch)
    return r.withColumnRenamed("record_id", "artifact_id")


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the documents' words meet the passages' ends by their hash, then word by word. The ends are two rows a passage."""
    words = passages(spark, sf_dir).select("qid", tokens(F.col("text")).alias("w"))
    ends = words.select("qid", F.explode(F.array(F.slice("w", 1, HELD), F.slice("w", F.greatest(F.lit(1), F.size("w") - (HELD - 1)), F.lit(HELD)))).alias("part")).where("size(part) > 0").distinct()
    held = ends.withColumn("h", F.xxhash64("part"))
    sizes = sorted(r[0] for r in ends.select(F.size("part")).distinct().collect())  # HELD numbers at most
    docs = _documents(spark, sf_dir).select("record_id", tokens(F.col("text")).alias("w"))

    def windows(n: int):
        return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, n)))).otherwise(F.array().cast("array<bigint>"))

    every = F.array_distinct(F.concat(*map(windows, sizes))) if sizes else F.array().cast("array<bigint>")
    hits = docs.select("record_id", "w", F.explode(every).alias("h")).join(F.broadcast(held) if held.limit(ENDS + 1).count() <= ENDS else held, "h")
    said = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return hits.where(F.contains(said(F.col("w")), said(F.col("part")))).select("qid", F.col("record_id").alias("artifact_id")).distinct()


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).withColumn("gain", F.lit(1.0))


def eval_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir)


def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.per_query(_ranked(spark, sf_dir), _qrels(spark, sf_dir), K)


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.report(_ranked(spark, sf_dir), _qrels(spark, sf_dir))


def eval_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.taxonomy(_ranked(spark, sf_dir), passages(spark, sf_dir), _gold(spark, sf_dir), abstain_floor=60.0)


def eval_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents that the corpus has no text of."""
    gold = table(spark, sf_dir, "labels").select(F.col("quality").alias("qid"), F.col("doc_id").alias("artifact_id")).distinct()
    return ev.unknown_gold(gold, _documents(spark, sf_dir).withColumnRenamed("record_id", "artifact_id"))


def eval_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    chosen = ranked.where("rank <= 2 AND score >= 60").select("qid", "artifact_id")
    return ev.selection_report(chosen, passages(spark, sf_dir), _gold(spark, sf_dir), ranked)


def sweep_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sweep(_ranked(spark, sf_dir), passages(spark, sf_dir), _gold(spark, sf_dir), (1, 3, 5), (0.5, 0.9), (None, 60.0))


def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ev.sweep(_ranked(spark, sf_dir), passages(spark, sf_dir), _gold(spark, sf_dir), (1, 3, 5), (0.5, 0.9), (None, 60.0))
    return ev.pareto(cells, "cell", "precision", "recall")


def _tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top score of each passage; positive where gold is among the first ``K``, null where it was missed."""
    gold, ranked = _gold(spark, sf_dir), _ranked(spark, sf_dir)
    seen = ranked.join(gold.withColumn("__g", F.lit(1)), ["qid", "artifact_id"], "left").groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max("__g").alias("__reached"))
    has = gold.select("qid").distinct().withColumn("__has", F.lit(True))
    joined = passages(spark, sf_dir).select("qid").join(has, "qid", "left").join(seen, "qid", "left")
    return joined.select("qid", "top", F.when(F.col("__has").isNull(), False).when(F.col("__reached") == 1, True).alias("positive"))


def calibrate_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.calibrate(_tops(spark, sf_dir))


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.score_summary(_tops(spark, sf_dir).where("positive IS NOT NULL"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as levels: good and harmless is core, good and toxic uses-tools, else tangential."""
    level = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "core").when(F.col("quality") == 1, "uses-tools").otherwise("tangential")
    one = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("toxic").alias("toxic"))
    return one.select(F.col("doc_id").alias("artifact_id"), level.alias("level"))


def graded_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's ranking against the grades of all labelled documents."""
    grades = _graded(spark, sf_dir).select("artifact_id", ev.gain_of(F.col("level")).alias("gain"))
    return ev.per_query(_ranked(spark, sf_dir), grades, K, shared=True).select("qid", "ndcg")


def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.level_histogram(_graded(spark, sf_dir))


def named_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard positives: the gold documents. Distractors: documents of the dense first ten without gold."""
    gold = _gold(spark, sf_dir)
    hard = gold.select(F.lit("held").alias("set_name"), F.lit("hard_positive").alias("kind"), "qid", "artifact_id")
    near = _dense(spark, sf_dir).join(gold, ["qid", "artifact_id"], "left_anti").select(F.lit("near").alias("set_name"), F.lit("distractor").alias("kind"), "qid", "artifact_id")
    return ev.named_sets(_ranked(spark, sf_dir), hard.unionByName(near), 5)


def compare_indexings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.compare({"lexical": _ranked(spark, sf_dir), "dense": _dense(spark, sf_dir)}, _qrels(spark, sf_dir), "lexical")


#: Sizes and trials of the distractor curve.
SIZES, TRIALS = (1, 4, 8, 16, 32, 64, 128), 20


def distractor_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distractors come from all documents. Draws (``TRIALS`` times the largest size) and gold (a row a passage) are small, so only these are scored."""
    held = lambda df: spark.createDataFrame(df.collect(), df.schema)
    docs = _documents(spark, sf_dir)
    drawn = held(ev.draw_distractors(docs.select(F.col("record_id").alias("artifact_id")), SIZES, TRIALS))
    gold = held(_gold(spark, sf_dir).groupBy("qid").agg(F.min("artifact_id").alias("artifact_id")))
    only = drawn.select("artifact_id").union(gold.select("artifact_id")).distinct().withColumnRenamed("artifact_id", "record_id")
    scores = ranking.bm25(docs, passages(spark, sf_dir), only=F.broadcast(only)).select("qid", F.col("record_id").alias("artifact_id"), "score")
    return ev.distractor_curve(scores, gold, drawn, SIZES)


def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("kind = 'readme' AND text LIKE '# %'").select("doc_id", F.regexp_extract("text", r"^# ([a-z]+)", 1).alias("name"), "text")
    masked = ev.mask_names(F.col("text"), F.col("name"))
    return rows.where("name <> ''").select("doc_id", F.sha2(masked, 256).alias("digest"), ev.leaks_name(F.col("text"), F.col("name")).alias("leaks_before"), ev.leaks_name(masked, F.col("name")).alias("leaks_after"))


def generated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.generate_cases(_documents(spark, sf_dir), "record_id").withColumnRenamed("record_id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        eval_gold, eval_per_query, eval_metrics, eval_taxonomy, eval_drift, eval_selection, sweep_selector, pareto_frontier, calibrate_floor, score_summary, graded_ndcg, level_histogram,
        named_sets, compare_indexings, distractor_curve, mask_names, generated_cases,
    )
}

_DOCS = "docs AS (SELECT doc_id AS record_id, text FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '')"
_GOLD = f"""said AS (SELECT record_id, ' ' || array_to_string({tokens_sql("text")}, ' ') || ' ' AS doc FROM docs), qw AS (SELECT qid, {tokens_sql("text")} AS w FROM queries),
ends_ AS (SELECT qid, ' ' || array_to_string(list_slice(w, 1, 13), ' ') || ' ' AS part FROM qw UNION SELECT qid, ' ' || array_to_string(list_slice(w, greatest(1, len(w) - 12), len(w)), ' ') || ' ' FROM qw),
gold AS (SELECT DISTINCT qid, record_id AS artifact_id FROM said JOIN ends_ ON contains(doc, part))"""
_BASE = f"{_DOCS}, {ASK}, {_GOLD}, {bm25_sql('docs', 10)}, ranked AS (SELECT qid, record_id AS artifact_id, score, rank FROM lexical)"


def _metrics_sql(qrels: str, ranked: str, k: int, prefix: str = "") -> str:
    p = prefix
    return f"""{p}rel AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, artifact_id) AS place FROM {qrels} WHERE gain > 0),
{p}ideal AS (SELECT qid, count(*) AS n, sum(CASE WHEN place <= {k} THEN gain / log2(place + 1.0) END) AS best FROM {p}rel GROUP BY qid),
{p}seen AS (SELECT r.qid, r.rank, coalesce(q.gain, 0.0) AS gain, sum(CASE WHEN q.gain > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.qid ORDER BY r.rank) AS so_far
        FROM {ranked} r LEFT JOIN {qrels} q ON q.qid = r.qid AND q.artifact_id = r.artifact_id WHERE r.rank <= {k}),
{p}got AS (SELECT qid, sum(gain / log2(rank + 1.0)) AS dcg, count(*) FILTER (gain > 0) AS hits, min(rank) FILTER (gain > 0) AS first_, sum(so_far::DOUBLE / rank) FILTER (gain > 0) AS ap FROM {p}seen GROUP BY qid),
{p}per AS (SELECT i.qid, round(coalesce(dcg / best, 0), 9) AS ndcg, round(coalesce(hits / n::DOUBLE, 0), 9) AS recall, round(coalesce(hits / {k}::DOUBLE, 0), 9) AS precision,
        round(coalesce(1.0::DOUBLE / first_, 0), 9) AS rr, round(coalesce(ap / least(n, {k}), 0), 9) AS ap FROM {p}ideal i LEFT JOIN {p}got USING (qid))"""


_QRELS = "qrels AS (SELECT *, 1.0::DOUBLE AS gain FROM gold)"
_SELECTION = """has AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid), reach AS (SELECT qid, count(*) AS n_found FROM ranked JOIN gold USING (qid, artifact_id) GROUP BY qid),
per AS (SELECT {by}c.qid, count(*) AS n_sel, count(g.qid) AS n_right FROM chosen c LEFT JOIN gold g ON g.qid = c.qid AND g.artifact_id = c.artifact_id GROUP BY ALL),
base AS (SELECT {b}q.qid, coalesce(n_gold, 0) AS n_gold, coalesce(n_found, 0) AS n_found FROM queries q LEFT JOIN has USING (qid) LEFT JOIN reach USING (qid){cross}),
rows_ AS (SELECT base.*, coalesce(n_sel, 0) AS n_sel, coalesce(n_right, 0) AS n_right FROM base LEFT JOIN per USING ({key}qid)),
rep AS (SELECT {k}count(*) FILTER (n_found > 0) AS n_scored, round(avg(CASE WHEN n_found > 0 THEN CASE WHEN n_sel > 0 THEN n_right::DOUBLE / n_sel ELSE 0 END END), 9) AS precision,
    round(avg(CASE WHEN n_found > 0 THEN n_right::DOUBLE / n_gold END), 9) AS recall, round(avg(CASE WHEN n_found > 0 THEN (n_sel > 0)::INT::DOUBLE END), 9) AS commit_rate,
    round(avg(CASE WHEN n_gold = 0 THEN (n_sel = 0)::INT::DOUBLE END), 9) AS abstention_accuracy, round(avg(CASE WHEN n_found > 0 THEN n_sel::DOUBLE END), 9) AS mean_size FROM rows_ {group}),
final AS (SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM rep)"""
_SWEEP = f"""WITH {_BASE}, grid AS (SELECT m AS max_k, r AS rel, f AS min_score, m || '/' || r || '/' || coalesce(f::VARCHAR, 'none') AS cell FROM (SELECT unnest([1, 3, 5])::INT AS m), (SELECT unnest([0.5, 0.9])::DOUBLE AS r), (SELECT unnest([NULL, 60.0])::DOUBLE AS f)),
t AS (SELECT *, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS top FROM ranked),
c AS (SELECT t.*, g.*, max(CASE WHEN rank > 1 AND (top <= 0 OR score / top < rel) THEN 1 ELSE 0 END) OVER (PARTITION BY cell, qid ORDER BY rank) AS bad FROM t, grid g),
chosen AS (SELECT cell, qid, artifact_id FROM c WHERE bad = 0 AND rank <= max_k AND (min_score IS NULL OR top >= min_score)),
cells AS (SELECT DISTINCT cell FROM chosen), {_SELECTION.format(by="c.cell, ", b="x.cell, ", cross=", cells x", key="cell, ", k="cell, ", group="GROUP BY cell")},
cells_ AS (SELECT g.cell, g.max_k, g.rel, g.min_score, f.* EXCLUDE (cell) FROM grid g LEFT JOIN final f ON f.cell = g.cell)"""
_TOPS = """tops AS (SELECT q.qid, r.score AS top, CASE WHEN q.qid NOT IN (SELECT qid FROM gold) THEN false WHEN q.qid IN (SELECT qid FROM ranked JOIN gold USING (qid, artifact_id)) THEN true END AS positive
    FROM queries q LEFT JOIN ranked r ON r.qid = q.qid AND r.rank = 1)"""
_GRADED = """graded AS (SELECT doc_id AS artifact_id, CASE WHEN q = 1 AND t = 0 THEN 'core' WHEN q = 1 THEN 'uses-tools' ELSE 'tangential' END AS level
    FROM (SELECT doc_id, max(quality) AS q, min(toxic) AS t FROM labels GROUP BY doc_id))"""
_DENSE = f"{hashed_sql('docs', 10)}, near AS (SELECT qid, record_id AS artifact_id, rank FROM dense)"

ORACLE_SQL = {
    "eval_gold": f"WITH {_DOCS}, {ASK}, {_GOLD} SELECT * FROM gold",
    "eval_per_query": f"WITH {_BASE}, {_QRELS}, {_metrics_sql('qrels', 'ranked', 10)} SELECT * FROM per",
    "eval_metrics": f"WITH {_BASE}, {_QRELS}, {', '.join(_metrics_sql('qrels', 'ranked', k, f'm{k}') for k in (1, 5, 10))} "
    + " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n_queries, round(avg(ndcg), 9) AS ndcg, round(avg(recall), 9) AS recall, round(avg(precision), 9) AS precision, round(avg(rr), 9) AS mrr, round(avg(ap), 9) AS map FROM m{k}per" for k in (1, 5, 10)),
    "eval_taxonomy": f"""WITH {_BASE}, best AS (SELECT qid, min(rank) AS best FROM ranked JOIN gold USING (qid, artifact_id) GROUP BY qid), top AS (SELECT qid, score AS top FROM ranked WHERE rank = 1)
        SELECT q.qid, CASE WHEN q.qid IN (SELECT qid FROM gold) THEN CASE WHEN best = 1 THEN 'hit_rank_1' WHEN best IS NOT NULL THEN 'surfaced_low_rank' ELSE 'retrieval_miss' END
               WHEN top IS NULL OR top < 60 THEN 'abstention_ok' ELSE 'false_action' END AS outcome FROM queries q LEFT JOIN best USING (qid) LEFT JOIN top USING (qid)""",
    "eval_drift": f"WITH {_DOCS} SELECT DISTINCT quality AS qid, doc_id AS artifact_id FROM labels WHERE doc_id NOT IN (SELECT record_id FROM docs)",
    "eval_selection": f"WITH {_BASE}, chosen AS (SELECT qid, artifact_id FROM ranked WHERE rank <= 2 AND score >= 60), {_SELECTION.format(by='', b='', cross='', key='', k='', group='')} SELECT * FROM final",
    "sweep_selector": f"{_SWEEP} SELECT * FROM cells_",
    "pareto_frontier": f"""{_SWEEP} SELECT cell, precision, recall FROM cells_ a WHERE precision IS NOT NULL AND recall IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM cells_ b WHERE b.precision >= a.precision AND b.recall >= a.recall AND (b.precision > a.precision OR b.recall > a.recall))""",
    "calibrate_floor": f"""WITH {_BASE}, {_TOPS}, s AS (SELECT DISTINCT top FROM tops WHERE top IS NOT NULL AND positive IS NOT NULL), m AS (SELECT (top + lead(top) OVER (ORDER BY top)) / 2 AS floor FROM s),
        e AS (SELECT min(top) AS a, max(top) AS b, CASE WHEN count(*) = 1 THEN abs(min(top)) * 0.5::DOUBLE + 1 ELSE (max(top) - min(top)) / count(*) END AS margin FROM s),
        f AS (SELECT floor FROM m WHERE floor IS NOT NULL UNION SELECT coalesce(a - margin, 0) FROM e UNION SELECT coalesce(b + margin, 0) FROM e),
        o AS (SELECT floor, avg(CASE WHEN positive THEN (coalesce(top, -1e300) >= floor)::INT END) AS sens, avg(CASE WHEN NOT positive THEN (coalesce(top, -1e300) < floor)::INT END) AS spec,
                     count(*) FILTER (positive) AS np, count(*) FILTER (NOT positive) AS nn, count(*) FILTER (positive IS NULL) AS nm FROM f, tops GROUP BY floor),
        b AS (SELECT *, round(0.5 * coalesce(sens, 1) + 0.5 * coalesce(spec, 1), 9) AS objective, np > 0 AND nn > 0 AS ok FROM o ORDER BY objective DESC, floor DESC LIMIT 1)
        SELECT CASE WHEN ok THEN round(floor, 9) END AS floor, CASE WHEN ok THEN objective END AS objective, CASE WHEN ok THEN round(sens, 9) WHEN np > 0 THEN 1.0 END AS sensitivity, CASE WHEN ok THEN round(spec, 9) WHEN nn > 0 THEN 1.0 END AS specificity,
               CASE WHEN ok THEN round(round(sens, 9) + round(spec, 9) - 1, 9) END AS youden_j, CASE WHEN ok THEN round((round(sens, 9) + round(spec, 9)) / 2, 9) END AS balanced_accuracy,
               np AS n_positive, nn AS n_negative, nm AS n_missed, ok AND EXISTS (SELECT 1 FROM o WHERE sens = 1 AND spec = 1) AS separable,
               CASE WHEN ok THEN 'calibrated' WHEN np = 0 AND nn = 0 THEN 'no_cases' WHEN np = 0 THEN 'no_positive_cases' ELSE 'no_abstention_cases' END AS reason FROM b""",
    "score_summary": f"WITH {_BASE}, {_TOPS} SELECT positive, count(*) AS n, min(top) AS least, round(median(top), 9) AS median, max(top) AS most FROM tops WHERE top IS NOT NULL AND positive IS NOT NULL GROUP BY positive",
    "graded_ndcg": f"""WITH {_DOCS}, {ASK}, {bm25_sql("docs", 10)}, ranked AS (SELECT qid, record_id AS artifact_id, rank FROM lexical), {_GRADED},
        qrels AS (SELECT qid, artifact_id, CASE level WHEN 'core' THEN 3.0 WHEN 'strong' THEN 2.0 WHEN 'uses-tools' THEN 1.0 ELSE 0.0 END::DOUBLE AS gain FROM (SELECT DISTINCT qid FROM ranked), graded),
        {_metrics_sql("qrels", "ranked", 10)} SELECT qid, ndcg FROM per""",
    "level_histogram": f"""WITH {_GRADED}, levels AS (SELECT * FROM (VALUES ('none', 0), ('tangential', 0), ('uses-tools', 1), ('strong', 2), ('core', 3)) v(level, gain))
        SELECT l.level, l.gain, count(g.level) AS n FROM levels l LEFT JOIN graded g USING (level) GROUP BY ALL""",
    "named_sets": f"""WITH {_BASE}, {_DENSE}, members AS (SELECT 'held' AS set_name, 'hard_positive' AS kind, qid, artifact_id FROM gold UNION ALL
            SELECT 'near', 'distractor', qid, artifact_id FROM near WHERE (qid, artifact_id) NOT IN (SELECT (qid, artifact_id) FROM gold))
        SELECT set_name, kind, count(*) AS n, round(avg((r.qid IS NOT NULL)::INT::DOUBLE), 9) AS rate, CASE WHEN kind = 'distractor' THEN 'fp_rate' ELSE 'recall' END AS measure
        FROM members m LEFT JOIN ranked r ON r.qid = m.qid AND r.artifact_id = m.artifact_id AND r.rank <= 5 GROUP BY ALL""",
    "compare_indexings": f"""WITH {_BASE}, {_DENSE} SELECT 'dense' AS label, g.qid, g.artifact_id, r.rank AS base_rank, n.rank AS rank, coalesce(n.rank, 1000000000) > coalesce(r.rank, 1000000000) AS regressed
        FROM gold g LEFT JOIN ranked r ON r.qid = g.qid AND r.artifact_id = g.artifact_id LEFT JOIN near n ON n.qid = g.qid AND n.artifact_id = g.artifact_id""",
    "distractor_curve": f"""WITH {_DOCS}, {ASK}, {_GOLD}, {bm25_sql("docs", None)}, one AS (SELECT qid, min(artifact_id) AS g FROM gold GROUP BY qid),
        own AS (SELECT o.qid, o.g, coalesce(l.score, 0) AS own FROM one o LEFT JOIN lexical l ON l.qid = o.qid AND l.record_id = o.g),
        size_ AS (SELECT count(DISTINCT record_id) AS n FROM docs), t AS (SELECT unnest(range({TRIALS})) AS trial),
        drawn AS (SELECT trial, record_id, row_number() OVER (PARTITION BY trial ORDER BY sha256('0/' || trial || '/' || record_id), record_id) AS place FROM docs, t QUALIFY place <= {max(SIZES) + 1}),
        mix AS (SELECT o.qid, d.trial, coalesce(l.score, 0) AS score, o.own, row_number() OVER (PARTITION BY o.qid, d.trial ORDER BY d.place) AS n
                FROM own o JOIN drawn d ON d.record_id <> o.g LEFT JOIN lexical l ON l.qid = o.qid AND l.record_id = d.record_id),
        cells AS (SELECT DISTINCT qid, trial, least(s, size_.n)::INT AS size FROM own, t, (SELECT unnest({list(SIZES)!r}) AS s), size_ WHERE trial = 0 OR s < size_.n),
        lost AS (SELECT c.qid, c.trial, c.size, max((m.score >= m.own)::INT) AS lost FROM cells c LEFT JOIN mix m ON m.qid = c.qid AND m.trial = c.trial AND m.n <= c.size - 1 GROUP BY ALL)
        SELECT size, round(avg(1.0 - coalesce(lost, 0)), 9) AS accuracy, count(*) AS n FROM lost GROUP BY size""",
    "generated_cases": rf"""WITH {_DOCS}, w AS (SELECT DISTINCT record_id, unnest({tokens_sql("text")}) AS term FROM docs), l AS (SELECT * FROM w WHERE length(term) > 2),
        f AS (SELECT term, count(*) AS df FROM l GROUP BY term), n AS (SELECT record_id, term, row_number() OVER (PARTITION BY record_id ORDER BY df, term) AS n FROM l JOIN f USING (term))
        SELECT record_id AS doc_id, string_agg(term, ' ' ORDER BY n) AS query FROM n WHERE n <= 6 GROUP BY record_id""",
    "mask_names": r"""WITH r AS (SELECT doc_id, regexp_extract(text, '^# ([a-z]+)', 1) AS name, text FROM documents WHERE kind = 'readme' AND text LIKE '# %'),
        m AS (SELECT *, regexp_replace(text, '(?i)\b' || name || '\b', 'it', 'g') AS masked FROM r WHERE name <> '')
        SELECT doc_id, sha256(masked) AS digest, list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), name) AS leaks_before, list_contains(regexp_extract_all(lower(masked), '[\p{L}\p{N}_]+'), name) AS leaks_after FROM m""",
}
