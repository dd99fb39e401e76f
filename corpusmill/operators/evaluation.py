"""Evaluation of rankings and selections: metrics, taxonomy, sweeps, calibration, graded and named sets.

Cases are ``(qid, gold)`` rows, one per gold id; a query without gold is an abstention case and appears in
``queries`` only. Rankings are ``(qid, rank, score, artifact_id)``. Definitions: linear gain for nDCG;
reciprocal rank and average precision up to k; AP is divided by min(relevant, k).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import tokens
from corpusmill.operators.skew import running_totals
from corpusmill.runtime import cut

#: Levels of graded relevance and their gains (fixed values).
LEVELS = {"none": 0, "tangential": 0, "uses-tools": 1, "strong": 2, "core": 3}


# --- metrics -------------------------------------------------------------------------------------


def judged(ranking: DataFrame, qrels: DataFrame) -> DataFrame:
    """The ranking with the gain of each hit; ``qrels``: ``(qid, artifact_id, gain)``."""
    return ranking.select("qid", "rank", "artifact_id").join(qrels, ["qid", "artifact_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


METRICS = ("ndcg", "recall", "precision", "rr", "ap")


def _measured(ranking: DataFrame, qrels: DataFrame, ks: list[int], shared: bool) -> DataFrame:
    """``qid, k`` and the metrics: the ranking meets the judgements once, whatever the number of depths."""
    most, zero = max(ks), F.lit(0.0)
    relevant = qrels.where("gain > 0")
    if shared:  # the same for every query: the best gains of all that is judged, no query crossed with it
        best = relevant.orderBy(F.col("gain").desc(), "artifact_id").limit(most).agg(F.sort_array(F.collect_list("gain"), asc=False).alias("__g"))
        ideal = ranking.select("qid").distinct().crossJoin(F.broadcast(relevant.agg(F.count(F.lit(1)).alias("__n")).where("__n > 0").crossJoin(best)))
        hits = ranking.select("qid", "rank", "artifact_id").where(F.col("rank") <= most).join(relevant, "artifact_id")
    else:
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("gain").desc(), "artifact_id"))
        kept = F.when(F.col("__p") <= most, F.col("gain"))
        ideal = relevant.withColumn("__p", place).groupBy("qid").agg(F.count(F.lit(1)).alias("__n"), F.sort_array(F.collect_list(kept), asc=False).alias("__g"))
        hits = ranking.select("qid", "rank", "artifact_id").where(F.col("rank") <= most).join(relevant, ["qid", "artifact_id"])
    seen = hits.withColumn("__so_far", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    got = seen.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "gain", "__so_far"))).alias("__h"))
    joined = ideal.join(got, "qid", "left").withColumn("__h", F.coalesce("__h", F.array().cast("array<struct<rank:int,gain:double,__so_far:int>>")))

    def total(items, value):
        return F.aggregate(items, zero, lambda acc, x: acc + value(x))

    def at(k: int):
        h = F.filter("__h", lambda x: x["rank"] <= k)
        dcg = total(h, lambda x: x["gain"] / F.log2(x["rank"] + 1.0))
        best = F.aggregate(F.slice("__g", 1, k), F.struct(zero.alias("s"), F.lit(1).alias("p")), lambda acc, g: F.struct((acc["s"] + g / F.log2(acc["p"] + 1.0)).alias("s"), (acc["p"] + 1).alias("p")), lambda acc: acc["s"])
        n = F.size(h)
        first = F.when(n > 0, 1.0 / F.element_at(h, 1)["rank"]).otherwise(zero)
        ap = total(h, lambda x: x["__so_far"] / x["rank"]) / F.least("__n", F.lit(k))
        values = (dcg / best, n / F.col("__n"), n / F.lit(float(k)), first, ap)
        return F.struct(F.lit(k).alias("k"), *(F.round(v, 9).alias(m) for m, v in zip(METRICS, values)))

    return joined.select("qid", F.inline(F.array(*(at(k) for k in ks))))


def per_query(ranking: DataFrame, qrels: DataFrame, k: int, shared: bool = False) -> DataFrame:
    """``qid, ndcg, recall, precision, rr, ap`` at ``k`` for every query that has a relevant artifact.

    ``shared``: the judgements ``(artifact_id, gain)`` hold for every query of the ranking.
    """
    return _measured(ranking, qrels, [k], shared).drop("k")


def report(ranking: DataFrame, qrels: DataFrame, ks: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """Means over the queries for several depths: ``k, n_queries, ndcg, recall, precision, mrr, map``."""
    rows = _measured(ranking, qrels, list(ks), False)
    means = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 9).alias(m) for m in METRICS))
    return means.withColumnsRenamed({"rr": "mrr", "ap": "map"})


def taxonomy(ranking: DataFrame, queries: DataFrame, gold: DataFrame, abstain_floor: float | None = None, k: int = 10) -> DataFrame:
    """``qid, outcome``: hit_rank_1, surfaced_low_rank, retrieval_miss for cases with gold; abstention_ok,
    false_action, abstention_unscored for those without."""
    tops = ranking.groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"))
    best = ranking.where(F.col("rank") <= k).join(gold, ["qid", "artifact_id"]).groupBy("qid").agg(F.min("rank").alias("best"))
    has = gold.select("qid").distinct().withColumn("__gold", F.lit(True))
    joined = queries.select("qid").join(has, "qid", "left").join(best, "qid", "left").join(tops, "qid", "left")
    floor = F.lit(abstain_floor).cast("double")
    outcome = (
        F.when(F.col("__gold") & (F.col("best") == 1), "hit_rank_1").when(F.col("__gold") & F.col("best").isNotNull(), "surfaced_low_rank").when(F.col("__gold"), "retrieval_miss")
        .when(floor.isNull(), "abstention_unscored").when(F.col("top").isNull() | (F.col("top") < floor), "abstention_ok").otherwise("false_action")
    )
    return joined.select("qid", outcome.alias("outcome"))


def unknown_gold(gold: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Gold ids that the corpus does not have (drift)."""
    return gold.join(artifacts.select("artifact_id").distinct(), "artifact_id", "left_anti").select("qid", "artifact_id")


# --- selection -----------------------------------------------------------------------------------


def selection_report(chosen: DataFrame, queries: DataFrame, gold: DataFrame, ranking: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall and F1 of what was selected, over cases whose gold was retrieved; abstention accuracy.

    ``chosen``: ``(*by, qid, artifact_id)`` selected hits. Grouped by ``by`` (the cells of a sweep).
    """
    has = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"))
    reachable = ranking.where(F.col("rank") <= k).join(gold, ["qid", "artifact_id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n_found"))
    hits = chosen.join(gold.withColumn("__g", F.lit(1)), ["qid", "artifact_id"], "left")
    per = hits.groupBy(*by, "qid").agg(F.count(F.lit(1)).alias("n_sel"), F.count("__g").alias("n_right"))
    base = queries.select("qid").join(has, "qid", "left").join(reachable, "qid", "left")
    if by:
        base = base.crossJoin(F.broadcast(chosen.select(*by).distinct()))
    rows = base.join(per, [*by, "qid"], "left").na.fill(0, ["n_sel", "n_right", "n_gold", "n_found"])
    scored = F.col("n_found") > 0
    precision = F.when(scored, F.when(F.col("n_sel") > 0, F.col("n_right") / F.col("n_sel")).otherwise(0.0))
    recall = F.when(scored, F.col("n_right") / F.col("n_gold"))
    agg = rows.groupBy(*by) if by else rows.groupBy()
    out = agg.agg(
        F.count(F.when(scored, 1)).alias("n_scored"), F.round(F.avg(precision), 9).alias("precision"), F.round(F.avg(recall), 9).alias("recall"),
        F.round(F.avg(F.when(scored, (F.col("n_sel") > 0).cast("double"))), 9).alias("commit_rate"),
        F.round(F.avg(F.when(F.col("n_gold") == 0, (F.col("n_sel") == 0).cast("double"))), 9).alias("abstention_accuracy"), F.round(F.avg(F.when(scored, F.col("n_sel").cast("double"))), 9).alias("mean_size"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 9))


def sweep(ranking: DataFrame, queries: DataFrame, gold: DataFrame, max_ks: Iterable[int], rels: Iterable[float], floors: Iterable[float | None], k: int = 10) -> DataFrame:
    """The selection report of every cell ``(max_k, rel, min_score)`` from one retrieval: the grid meets the ranking once."""
    spark = ranking.sparkSession
    grid = spark.createDataFrame([(int(m), float(r), None if f is None else float(f)) for m in max_ks for r in rels for f in floors], "max_k int, rel double, min_score double")
    w = Window.partitionBy("qid").orderBy("rank")
    top = ranking.where(F.col("rank") <= k).select("qid", "rank", "artifact_id", "score", F.first("score").over(w).alias("__top"))
    cells = top.crossJoin(F.broadcast(grid))
    share = F.when(F.col("__top") > 0, F.col("score") / F.col("__top"))
    fails = F.when((F.col("rank") > 1) & (share.isNull() | (share < F.col("rel"))), 1).otherwise(0)
    marked = cells.withColumn("__fail", F.max(fails).over(Window.partitionBy("max_k", "rel", "min_score", "qid").orderBy("rank")))
    chosen = marked.where((F.col("__fail") == 0) & (F.col("rank") <= F.col("max_k")) & (F.col("min_score").isNull() | (F.col("__top") >= F.col("min_score"))))
    named = grid.withColumn("cell", F.concat_ws("/", "max_k", "rel", F.coalesce(F.col("min_score").cast("string"), F.lit("none"))))
    keyed = chosen.withColumn("cell", F.concat_ws("/", "max_k", "rel", F.coalesce(F.col("min_score").cast("string"), F.lit("none"))))
    per = selection_report(keyed.select("cell", "qid", "artifact_id"), queries, gold, ranking, k, by=("cell",))
    return named.join(per, "cell", "left")


def pareto(cells: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Cells that no other beats in one measure without losing in the other: a running maximum, no self-join."""
    points = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    before = Window.orderBy(F.col(x).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best_y = points.groupBy(x).agg(F.max(y).alias("__y"))
    # the measures are few distinct values (cells of a grid), so the one-partition window is over them, not over the rows
    front = best_y.withColumn("__run", F.max("__y").over(before)).withColumn("__prev", F.max("__y").over(Window.orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1)))
    front = front.where(F.col("__prev").isNull() | (F.col("__y") > F.col("__prev"))).select(x, F.col("__y").alias(y))
    return points.join(front, [x, y], "left_semi").select(key, x, y)


# --- calibration ---------------------------------------------------------------------------------


def calibrate(tops: DataFrame, weight: float = 0.5) -> DataFrame:
    """The floor that best parts queries whose gold was retrieved from those without gold, by their top scores.

    ``tops``: ``(qid, top, positive)``; ``positive`` is null for a query whose gold was missed, which says
    nothing about a floor and is counted only; a null or NaN top (nothing retrieved) is under any floor.
    Candidates are the midpoints of neighbouring distinct scores and one beyond either end; the objective is
    ``weight * sensitivity + (1 - weight) * specificity``; equal ones give the higher floor. One row:
    ``floor, objective, sensitivity, specificity, youden_j, balanced_accuracy, n_positive, n_negative, n_missed,
    separable, reason``. Without both classes there is no floor.

    Running counts over the distinct scores, range-partitioned, so every candidate is scored in one pass.
    """
    tops = cut(tops.select("qid", "top", "positive"))  # a row a query, read four times
    totals = tops.agg(F.count(F.when(F.col("positive"), 1)).alias("__p"), F.count(F.when(~F.col("positive"), 1)).alias("__n"), F.count(F.when(F.col("positive").isNull(), 1)).alias("n_missed"))
    finite = tops.where(F.col("positive").isNotNull() & F.col("top").isNotNull() & ~F.isnan(F.col("top").cast("double")))
    by_score = finite.groupBy("top").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("n"))
    runs = running_totals(by_score, "top", ["p", "n"])
    middle = runs.where("next IS NOT NULL").select(((F.col("top") + F.col("next")) / 2).alias("floor"), "p_run", "n_run")
    ends = by_score.agg(F.count(F.lit(1)).alias("c"), F.min("top").alias("a"), F.max("top").alias("b"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    margin = F.when(F.col("c") == 1, F.abs("a") * 0.5 + 1.0).otherwise((F.col("b") - F.col("a")) / F.col("c"))
    none = F.lit(0).cast("bigint")
    outer = F.array(
        F.struct(F.coalesce(F.col("a") - margin, F.lit(0.0)).alias("floor"), F.coalesce("p", none).alias("p_run"), F.coalesce("n", none).alias("n_run")),
        F.struct(F.coalesce(F.col("b") + margin, F.lit(0.0)).alias("floor"), none.alias("p_run"), none.alias("n_run")),
    )
    scored = middle.unionByName(ends.select(F.inline(outer))).crossJoin(F.broadcast(totals))
    sens = F.when(F.col("__p") > 0, F.col("p_run") / F.col("__p")).otherwise(1.0)
    spec = F.when(F.col("__n") > 0, (F.col("__n") - F.col("n_run")) / F.col("__n")).otherwise(1.0)
    rows = scored.select("floor", F.round(weight * sens + (1 - weight) * spec, 9).alias("objective"), F.round(sens, 9).alias("s"), F.round(spec, 9).alias("c"))
    best = rows.agg(F.max(F.struct("objective", "floor", "s", "c")).alias("b"), F.max((F.col("s") == 1) & (F.col("c") == 1)).alias("any_separates"))
    p, n = F.col("__p"), F.col("__n")
    both = (p > 0) & (n > 0)
    joined = totals.crossJoin(F.broadcast(best))
    sensitivity, specificity = F.when(both, F.col("b.s")).when(p > 0, 1.0), F.when(both, F.col("b.c")).when(n > 0, 1.0)
    reason = F.when(both, "calibrated").when((p == 0) & (n == 0), "no_cases").when(p == 0, "no_positive_cases").otherwise("no_abstention_cases")
    return joined.select(
        F.round(F.when(both, F.col("b.floor")), 9).alias("floor"), F.when(both, F.col("b.objective")).alias("objective"), sensitivity.alias("sensitivity"), specificity.alias("specificity"),
        F.when(both, F.round(F.col("b.s") + F.col("b.c") - 1, 9)).alias("youden_j"), F.when(both, F.round((F.col("b.s") + F.col("b.c")) / 2, 9)).alias("balanced_accuracy"),
        p.alias("n_positive"), n.alias("n_negative"), "n_missed", (both & F.col("any_separates")).alias("separable"), reason.alias("reason"),
    )


def score_summary(tops: DataFrame, by: str = "positive") -> DataFrame:
    """Least, median and greatest finite top score per class."""
    finite = tops.where(F.col("top").isNotNull() & ~F.isnan("top") & (F.abs("top") != F.lit(float("inf"))))
    return finite.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("least"), F.round(F.median("top"), 9).alias("median"), F.max("top").alias("most"))


# --- graded relevance and named sets -------------------------------------------------------------


def gain_of(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, gain in LEVELS.items():
        out = F.when(level == name, float(gain)).otherwise(out)
    return out


def level_histogram(labels: DataFrame) -> DataFrame:
    """Count of every level, those that don't occur included."""
    levels = labels.sparkSession.createDataFrame([(n, g) for n, g in LEVELS.items()], "level string, gain int")
    return levels.join(labels.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", "left").select("level", "gain", F.coalesce("n", F.lit(0)).alias("n"))


def named_sets(ranking: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """Per named set (``set_name, kind`` distractor or hard_positive, ``qid, artifact_id``): the share that is among the first k."""
    seen = ranking.where(F.col("rank") <= k).select("qid", "artifact_id", F.lit(1).alias("__in"))
    joined = members.join(seen, ["qid", "artifact_id"], "left")
    rate = F.round(F.avg(F.coalesce("__in", F.lit(0)).cast("double")), 9)
    return joined.groupBy("set_name", "kind").agg(F.count(F.lit(1)).alias("n"), rate.alias("rate")).withColumn("measure", F.when(F.col("kind") == "distractor", "fp_rate").otherwise("recall"))


def compare(rankings: Mapping[str, DataFrame], qrels: DataFrame, baseline: str, k: int = 10) -> DataFrame:
    """Rank of every relevant artifact under each labelled ranking, and its change against the baseline (absent: null, worst)."""
    relevant = qrels.where("gain > 0").select("qid", "artifact_id")
    every = None
    for label, r in rankings.items():
        one = relevant.join(r.select("qid", "artifact_id", F.col("rank").alias("rank")).where(F.col("rank") <= k), ["qid", "artifact_id"], "left").withColumn("label", F.lit(label))
        every = one if every is None else every.unionByName(one)
    absent = F.lit(1_000_000_000)
    base = every.where(F.col("label") == baseline).select("qid", "artifact_id", F.coalesce("rank", absent).alias("__base"))
    joined = every.where(F.col("label") != baseline).join(base, ["qid", "artifact_id"])
    return joined.select("label", "qid", "artifact_id", F.when(F.col("__base") < absent, F.col("__base")).cast("int").alias("base_rank"), F.col("rank").cast("int").alias("rank"), (F.coalesce("rank", absent) > F.col("__base")).alias("regressed"))


# --- distractor curve ----------------------------------------------------------------------------


def draw_distractors(scope: DataFrame, sizes: Iterable[int], trials: int, seed: int = 0) -> DataFrame:
    """``trial, artifact_id, place``: per trial the first artifacts of the whole scope by a hash of trial and id, the same in any engine.

    One more than the largest size, which tells whether the scope is larger.
    """
    tried = scope.sparkSession.range(trials).select(F.col("id").cast("int").alias("trial"))
    key = F.sha2(F.concat_ws("/", F.lit(seed), "trial", F.col("artifact_id").cast("string")), 256)
    mixed = scope.select("artifact_id").distinct().crossJoin(F.broadcast(tried)).withColumn("__key", key)
    nth = F.row_number().over(Window.partitionBy("trial").orderBy("__key", "artifact_id"))
    return mixed.withColumn("place", nth).where(F.col("place") <= max(sizes) + 1).select("trial", "artifact_id", "place")


def distractor_curve(scores: DataFrame, gold: DataFrame, drawn: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """Accuracy at 1 against the size of the catalogue: ``size, accuracy, n``.

    Per probe and trial the catalogue is the gold artifact and the first ``size - 1`` others of ``drawn``
    (``draw_distractors`` of the same sizes). ``scores``: ``(qid, artifact_id, score)`` of the drawn and the gold
    artifacts; one without a score counts 0 for a probe. Ties go to the gold's rivals (the pessimistic reading).
    Sizes beyond the scope become that of the scope, and the whole scope is tried once.
    """
    spark = scores.sparkSession
    tried = drawn.groupBy("trial").agg(F.max("place").alias("__all"))  # up to the largest size this is the scope
    one = gold.groupBy("qid").agg(F.min("artifact_id").alias("gold_id"))
    own = one.join(scores, (one["qid"] == scores["qid"]) & (one["gold_id"] == scores["artifact_id"]), "left").select(one["qid"], "gold_id", F.coalesce("score", F.lit(0.0)).alias("__own"))
    rivals = own.crossJoin(F.broadcast(drawn)).where(F.col("artifact_id") != F.col("gold_id")).join(scores, ["qid", "artifact_id"], "left")
    # a place after that of the gold artifact moves up by one
    mine = one.join(drawn, F.col("gold_id") == F.col("artifact_id")).select("qid", "trial", F.col("place").alias("__gold"))
    wins = F.coalesce("score", F.lit(0.0)) >= F.col("__own")
    placed = rivals.join(mine, ["qid", "trial"], "left").withColumn("__n", F.col("place") - (F.coalesce(F.col("place") > F.col("__gold"), F.lit(False))).cast("int"))
    first = placed.where(wins).groupBy("qid", "trial").agg(F.min("__n").alias("__lost"))
    dim = spark.createDataFrame([(int(s),) for s in sorted(set(sizes))], "size int")
    at = own.select("qid").crossJoin(F.broadcast(tried)).crossJoin(F.broadcast(dim)).select("qid", "trial", F.least("size", "__all").alias("size"), "__all").distinct()
    at = at.where((F.col("trial") == 0) | (F.col("size") < F.col("__all")))
    full = at.join(first, ["qid", "trial"], "left")
    won = F.when(F.col("__lost") <= F.col("size") - 1, 0.0).otherwise(1.0)
    return full.groupBy("size").agg(F.round(F.avg(won), 9).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# --- generated cases -----------------------------------------------------------------------------


def name_pattern(name: str) -> str:
    """A pattern for a name whatever separates its parts."""
    parts = [re.escape(p) for p in re.split(r"[-_.\s]+", name) if p]
    return r"(?i)\b" + r"[-_.\s]*".join(parts) + r"\b"


def mask_names(text: Column, name: Column, mask: str = "it") -> Column:
    """A description without the name of what it describes (names of letters, digits and separators)."""
    parts = F.filter(F.split(name, r"[-_.\s]+"), lambda p: p != "")
    pattern = F.concat(F.lit(r"(?i)\b"), F.array_join(parts, r"[-_.\s]*"), F.lit(r"\b"))
    return F.when(F.size(parts) > 0, F.regexp_replace(text, pattern, F.lit(mask))).otherwise(text)


def leaks_name(text: Column, name: Column) -> Column:
    """Whether all parts of a name still occur in a text as words."""
    parts = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda p: p != "")
    return (F.size(parts) > 0) & (F.size(F.array_except(parts, tokens(text))) == 0)


def generate_cases(documents: DataFrame, key: str = "artifact_id", text: str = "text", terms: int = 6) -> DataFrame:
    """The offline query generator: the rarest terms of a document, by document frequency, then alphabet."""
    words = documents.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).where(F.length("term") > 2)
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy(key).orderBy("df", "term")
    rare = words.join(df, "term").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= terms)
    return rare.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "term"))), lambda x: x["term"]), " ").alias("query"))


def abstentions_needed(n_gold: int, share: float) -> int:
    """How many abstention cases give them a share of the whole set."""
    return math.ceil(share * n_gold / (1 - share)) if 0 < share < 1 else 0
