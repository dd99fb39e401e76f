"""Selection: which few hits of a ranking apply, or none - and discovery built on it.

Selectors work on a ranking ``(qid, rank, score, ...)`` of any number of queries. A query without hits
can't appear in a ranking, so the per-query results start from the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import mentions
from corpusmill.operators import ranking

MAX_K, REL, GAP = 3, 0.9, 0.5


def _by_rank():
    return Window.partitionBy("qid").orderBy("rank")


def top_k(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def abs_threshold(hits: DataFrame, floor: float) -> DataFrame:
    return hits.where(F.col("score") >= floor)


def rel_threshold(hits: DataFrame, ratio: float = REL) -> DataFrame:
    """Hits of at least ``ratio`` times the top score; a top of 0 or less keeps the first only."""
    first = F.first("score").over(_by_rank().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keep = F.when(first <= 0, F.col("rank") == 1).otherwise(F.col("score") >= ratio * first)
    return hits.withColumn("__keep", keep).where("__keep").drop("__keep")


def score_gap(hits: DataFrame, gap_ratio: float = GAP) -> DataFrame:
    """Hits before the first that falls under ``gap_ratio`` times the one before it."""
    last = F.lag("score").over(_by_rank())
    broken = F.when(last.isNotNull() & ((last <= 0) | (F.col("score") < gap_ratio * last)), 1).otherwise(0)
    marked = hits.withColumn("__broken", broken)
    return marked.withColumn("__cut", F.max("__broken").over(_by_rank())).where("__cut = 0").drop("__broken", "__cut")


def conservative(hits: DataFrame, queries: DataFrame, max_k: int = MAX_K, rel: float = REL, min_score: float | Column | None = None) -> DataFrame:
    """One row per query: ``qid, selected, abstained, reason, n_candidates, n_selected, top_score, min_ratio``.

    Keeps the first hit and admits the next while its share of the top score is at least ``rel``, ``max_k`` at
    most. Abstains without candidates and when the top is under the floor. ``selected`` joins artifact ids;
    ``min_ratio`` is the least share admitted. Reason: ``rel_threshold`` where a share was too small, else
    ``single``, ``nonpositive_top``, ``max_k`` where candidates are left, ``exhausted``.
    """
    floor = min_score if isinstance(min_score, Column) else F.lit(min_score).cast("double")
    first = F.first("score").over(_by_rank().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = F.when(first > 0, F.col("score") / first)
    stops = F.when((F.col("rank") > 1) & (share.isNull() | (share < rel)), 1).otherwise(0)
    marked = hits.select("qid", "rank", "score", "artifact_id", first.alias("__top"), share.alias("__share"), stops.alias("__stop"))
    marked = marked.withColumn("__cut", F.max("__stop").over(_by_rank())).withColumn("__in", (F.col("__cut") == 0) & (F.col("rank") <= max_k))
    per = marked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.max("__top").alias("top_score"), F.count(F.when(F.col("__in"), 1)).alias("k"), F.min(F.when(F.col("__in"), F.col("__share"))).alias("min_ratio"),
        F.array_sort(F.collect_list(F.when(F.col("__in"), F.struct("rank", "artifact_id")))).alias("ids"),
    )
    joined = queries.select("qid", floor.alias("__floor")).join(per, "qid", "left")
    n = F.coalesce("n", F.lit(0))
    below = F.coalesce(F.col("top_score") < F.col("__floor"), F.lit(False))
    abstained = (n == 0) | below
    reason = (
        F.when(n == 0, "abstain:no_candidates").when(below, "abstain:below_floor")
        .when((F.col("top_score") > 0) & (F.col("k") < F.least(n, F.lit(max_k))), "rel_threshold").when(n == 1, "single")
        .when(F.col("top_score") <= 0, "nonpositive_top").when(n > max_k, "max_k").otherwise("exhausted")
    )
    names = F.array_join(F.transform("ids", lambda x: x["artifact_id"]), "|")
    return joined.select(
        "qid", F.when(abstained, "").otherwise(names).alias("selected"), abstained.alias("abstained"), reason.alias("reason"), n.cast("bigint").alias("n_candidates"),
        F.when(abstained, 0).otherwise(F.col("k")).cast("bigint").alias("n_selected"), "top_score", F.when(~abstained, F.coalesce("min_ratio", F.lit(1.0))).alias("min_ratio"),
    )


def by_callable(
    hits: DataFrame, chooser: Callable[[int, list], list], schema: str = "qid bigint, artifact_id string", max_candidates: int | None = None, max_k: int = MAX_K, rel: float = REL
) -> DataFrame:
    """An injected selector: ``chooser(qid, [(rank, artifact_id, score), ...])`` gives the chosen ids of a query.

    It sees the first ``max_candidates``. Ids that are no candidate are passed over; where it fails or none is
    left, the rule of :func:`conservative` decides, so a query never loses its answer to a bad reply. Grouped in
    Arrow batches; a query's candidates are as many as the ranking's depth.
    """
    import pandas as pd

    names = [p.split()[0] for p in schema.split(", ")]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        qid = pdf["qid"].iloc[0]
        rows = list(zip(pdf["rank"], pdf["artifact_id"], pdf["score"]))
        known = {r[1] for r in rows}
        try:
            chosen = [i for i in chooser(qid, rows[:max_candidates]) if i in known]
        except Exception:  # whatever an injected model raises
            chosen = []
        if not chosen:
            top, chosen = rows[0][2], [rows[0][1]]
            for _, i, score in rows[1:max_k]:
                if top <= 0 or score / top < rel:
                    break
                chosen.append(i)
        return pd.DataFrame({names[0]: [qid] * len(chosen), names[1]: list(chosen)})

    return hits.select("qid", "rank", "artifact_id", "score").groupBy("qid").applyInPandas(choose, schema)


def dedup_by(hits: DataFrame, key: str) -> DataFrame:
    """The first hit of each value of a metadata field; hits without one are all kept. Ranked anew."""
    nth = F.row_number().over(Window.partitionBy("qid", key).orderBy("rank"))
    kept = hits.withColumn("__n", nth).where((F.col("__n") == 1) | F.col(key).isNull()).drop("__n")
    return kept.withColumn("rank", F.row_number().over(_by_rank()))


def lexical_miss(hits: DataFrame, queries: DataFrame, required: Iterable[str], top_hits: int = 10) -> DataFrame:
    """``qid, zero_hits, missing_required, missing_in_candidates``: required terms that no (selected) hit mentions."""
    terms = list(required)
    seen = hits.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.max(mentions(F.col("text"), F.lit(t)).cast("int")).alias(f"__a{k}") for k, t in enumerate(terms)),
        *(F.max((mentions(F.col("text"), F.lit(t)) & (F.col("rank") <= top_hits)).cast("int")).alias(f"__t{k}") for k, t in enumerate(terms)),
    )
    joined = queries.select("qid").join(seen, "qid", "left")

    def missing(prefix: str) -> Column:
        return F.concat_ws(",", *(F.when(F.coalesce(F.col(f"{prefix}{k}"), F.lit(0)) == 0, t) for k, t in enumerate(terms)))

    return joined.select("qid", F.col("n").isNull().alias("zero_hits"), missing("__t").alias("missing_required"), missing("__a").alias("missing_in_candidates"))


# --- disclosure ----------------------------------------------------------------------------------

BODY_CHARS = 20_000


def disclose(hits: DataFrame, bodies: DataFrame, level: str = "metadata") -> DataFrame:
    """Hits with their body up to ``BODY_CHARS`` (levels ``body`` and ``bundled``) and a note where it can't be read.

    ``bodies``: ``(pointer, body)``. ``bundled`` adds the length of the whole body.
    """
    if level not in ("metadata", "body", "bundled"):
        raise ValueError(f"unknown level {level!r}")
    if level == "metadata":
        return hits.withColumn("body", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    found = hits.join(bodies.select("pointer", F.col("body").alias("__body")), "pointer", "left")
    note = F.when(F.col("pointer").isNotNull() & F.col("__body").isNull(), "pointer_unreadable").when(F.length("__body") > BODY_CHARS, "truncated")
    out = found.withColumn("body", F.left("__body", F.lit(BODY_CHARS))).withColumn("note", note)
    return (out.withColumn("body_chars", F.length("__body")) if level == "bundled" else out).drop("__body")


# --- discovery -----------------------------------------------------------------------------------


def discover(hits: DataFrame, queries: DataFrame, dedup: str | None = None, **selector) -> DataFrame:
    """Ranking to decision: optional de-duplication, then :func:`conservative`."""
    return conservative(dedup_by(hits, dedup) if dedup else hits, queries, **selector)


def federated(hits: DataFrame, queries: DataFrame, floors: Mapping[str, float | None], merge: str = "rrf", weights: Mapping[str, float] | None = None, max_k: int = MAX_K, rel: float = REL) -> DataFrame:
    """Several sources: each gated by its own floor on raw scores, merged, selected without a floor.

    ``hits``: ``(qid, source, artifact_id, score, pos)``. A query abstains as ``all_sources_below_floor`` where
    every source that had hits has a floor and missed it, as ``no_surviving_sources`` where nothing is left
    for other reasons, as ``no_candidates`` where there were no hits at all.
    """
    if merge not in ("rrf", "score"):
        raise ValueError(f"unknown merge {merge!r}")
    floor = F.lit(None).cast("double")
    for source, value in floors.items():
        floor = F.when(F.col("source") == source, F.lit(value).cast("double")).otherwise(floor)
    tops = hits.groupBy("qid", "source").agg(F.max("score").alias("top")).withColumn("floor", floor)
    gated = tops.withColumn("passes", F.col("floor").isNull() | (F.col("top") >= F.col("floor")))
    alive = hits.join(gated.where("passes").select("qid", "source"), ["qid", "source"], "left_semi")
    merged = ranking.fuse_hits(alive, weights=weights) if merge == "rrf" else ranking.top(alive, None, ties=("pos", "artifact_id"))
    chosen = conservative(merged, queries, max_k=max_k, rel=rel)
    per = gated.groupBy("qid").agg(F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col("passes"), 1)).alias("alive"), F.count("floor").alias("floored"))
    joined = chosen.join(per, "qid", "left")
    why = F.when(F.col("sources").isNull(), "abstain:no_candidates").when((F.col("alive") == 0) & (F.col("floored") == F.col("sources")), "abstain:all_sources_below_floor").when(F.col("alive") == 0, "abstain:no_surviving_sources")
    return joined.select("qid", "selected", "abstained", F.when(F.col("abstained"), why).otherwise(F.col("reason")).alias("reason"), "n_candidates", "n_selected")
