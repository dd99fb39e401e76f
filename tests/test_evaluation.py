import math

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.skew import running_totals
from corpusmill.operators import cases, evaluation as ev
from corpusmill.runtime import shared_dir


@pytest.fixture
def ranked(spark):
    rows = [(1, 1, 0.9, "a"), (1, 2, 0.8, "b"), (1, 3, 0.7, "c"), (2, 1, 0.5, "x"), (2, 2, 0.4, "a"), (3, 1, 0.2, "z")]
    return spark.createDataFrame(rows, "qid int, rank int, score double, artifact_id string")


@pytest.fixture
def gold(spark):
    return spark.createDataFrame([(1, "b"), (1, "q"), (2, "x"), (4, "n")], "qid int, artifact_id string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(q,) for q in (1, 2, 3, 4, 5)], "qid int")


def test_metrics(ranked, gold):
    by = {r.qid: r for r in ev.per_query(ranked, gold.withColumn("gain", F.lit(1.0)), 3).collect()}
    assert by[1].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-8)
    assert (by[1].recall, by[1].rr, by[1].ap) == (0.5, 0.5, 0.25) and by[1].precision == pytest.approx(1 / 3, abs=1e-8)
    assert (by[2].ndcg, by[2].rr) == (1.0, 1.0) and by[4].ndcg == 0.0 and 3 not in by


def test_taxonomy_and_drift(spark, ranked, gold, asked, rows):
    got = dict(rows(ev.taxonomy(ranked, asked, gold, 0.3)))
    assert got == {1: "surfaced_low_rank", 2: "hit_rank_1", 3: "abstention_ok", 4: "retrieval_miss", 5: "abstention_ok"}
    assert dict(rows(ev.taxonomy(ranked, asked, gold)))[3] == "abstention_unscored"
    assert rows(ev.unknown_gold(gold, ranked)) == [(1, "q"), (4, "n")]


def test_selection_sweep_and_frontier(ranked, gold, asked, rows):
    one = ev.selection_report(ranked.where("rank = 1").select("qid", "artifact_id"), asked, gold, ranked).first()
    assert (one.n_scored, one.precision, one.recall, one.abstention_accuracy) == (2, 0.5, 0.5, 0.5)
    cells = ev.sweep(ranked, asked, gold, (1, 2), (0.5,), (None,))
    by = {r.max_k: r for r in cells.collect()}
    assert by[1].precision == 0.5 and by[2].recall == 0.75 and by[2].f1 > by[1].f1
    front = rows(ev.pareto(cells.sparkSession.createDataFrame([("a", 1.0, 0.1), ("b", 0.5, 0.5), ("c", 0.5, 0.4), ("d", 0.5, 0.5)], "cell string, p double, r double"), "cell", "p", "r"), "cell")
    assert front == [("a",), ("b",), ("d",)]


def test_calibration(spark):
    tops = spark.createDataFrame([(1, 0.9, True), (2, 0.8, True), (3, 0.3, False), (4, None, False), (5, None, True)], "qid int, top double, positive boolean")
    got = ev.calibrate(tops).first()
    assert got.floor == pytest.approx(0.55) and got.specificity == 1.0 and got.sensitivity == pytest.approx(2 / 3, abs=1e-8) and not got.separable
    tie = ev.calibrate(spark.createDataFrame([(1, 0.5, True), (2, 0.5, False)], tops.schema)).first()
    assert tie.floor == pytest.approx(1.75)  # equal objectives: the higher floor, half the score and one beyond a single score
    none = ev.calibrate(tops.limit(0)).first()
    assert none.floor is None and none.reason == "no_cases" and not none.separable
    missed = ev.calibrate(spark.createDataFrame([(1, 0.9, True), (2, 0.1, None), (3, 0.3, False), (4, float("nan"), False)], tops.schema)).first()
    assert (missed.n_positive, missed.n_negative, missed.n_missed, missed.separable) == (1, 2, 1, True) and missed.floor == pytest.approx(0.6)
    one = ev.calibrate(spark.createDataFrame([(1, 0.9, True), (2, 0.1, None)], tops.schema)).first()
    assert (one.floor, one.sensitivity, one.specificity, one.reason) == (None, 1.0, None, "no_abstention_cases")


def test_running_totals(spark):
    """Over several partitions, the totals and next values are those of one ordered list."""
    values = [(float(k * 7 % 101), k % 3, 1) for k in range(101)]
    df = spark.createDataFrame(values, "x double, a long, b long").repartition(5)
    got = sorted(((r.x, r.a_run, r.b_run, r.next) for r in running_totals(df, "x", ["a", "b"]).collect()), reverse=True)
    want, a, b, ordered = [], 0, 0, sorted(values, reverse=True)
    for k, (x, p, q) in enumerate(ordered):
        a, b = a + p, b + q
        want.append((x, a, b, ordered[k + 1][0] if k < 100 else None))
    assert got == want


def test_shared_judgements_count_beyond_the_ranking(spark):
    ranked = spark.createDataFrame([(1, 1, 1.0, "a"), (1, 2, 0.5, "z")], "qid int, rank int, score double, artifact_id string")
    grades = spark.createDataFrame([("a", 1.0), ("far", 3.0), ("no", 0.0)], "artifact_id string, gain double")
    got = ev.per_query(ranked, grades, 2, shared=True).first()
    assert got.ndcg == pytest.approx(1 / (3 + 1 / math.log2(3)), abs=1e-8) and (got.recall, got.precision, got.rr, got.ap) == (0.5, 0.5, 1.0, 0.5)


def test_named_sets_histogram_and_comparison(spark, ranked, gold, rows):
    members = spark.createDataFrame([("d", "distractor", 1, "a"), ("d", "distractor", 1, "no"), ("h", "hard_positive", 2, "x")], "set_name string, kind string, qid int, artifact_id string")
    assert rows(ev.named_sets(ranked, members, 2), "set_name", "rate") == [("d", 0.5), ("h", 1.0)]
    levels = {r.level: r.n for r in ev.level_histogram(spark.createDataFrame([("core",), ("core",)], "level string")).collect()}
    assert levels == {"none": 0, "tangential": 0, "uses-tools": 0, "strong": 0, "core": 2}
    worse = ranked.where("qid <> 2")
    got = rows(ev.compare({"base": ranked, "new": worse}, gold.withColumn("gain", F.lit(1.0)), "base"), "qid", "artifact_id", "regressed")
    assert got == [(1, "b", False), (1, "q", False), (2, "x", True), (4, "n", False)]


def test_generated_cases(spark, rows):
    docs = spark.createDataFrame([("a", "common rare1 rare2 my_tool"), ("b", "common other")], "artifact_id string, text string")
    assert rows(ev.generate_cases(docs, terms=2)) == [("a", "my_tool rare1"), ("b", "other common")]
    masked = docs.select(ev.mask_names(F.lit("Use My-Tool, mytool."), F.lit("my_tool")).alias("m")).first().m
    assert masked == "Use it, it."
    assert ev.abstentions_needed(30, 0.25) == 10


def test_case_files(spark):
    path = cases.save_cases(spark, shared_dir(spark) + "/cases", "c", [{"query": "q1", "gold": ["a"]}, {"query": "none", "gold": []}], {"v": 1})
    loaded = cases.load_cases(spark, path)
    assert loaded.count() == 2 and cases.gold_rows(loaded).count() == 1 and cases.read_meta(spark, path) == {"v": 1}
    assert cases.calibration_key("hybrid", cases.rerank_tag("Mini LM", 200)) == "hybrid+mini-lm@200"
    with pytest.raises(ValueError):
        cases.rerank_tag(lambda q, p: p)
