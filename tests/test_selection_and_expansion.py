import pytest
from pyspark.sql import functions as F

from corpusmill.operators import expansion, selection


@pytest.fixture
def hits(spark):
    data = [(1, 1.0), (1, 0.95), (1, 0.91), (1, 0.4), (2, 0.5), (3, -0.1), (3, -0.2), (5, 1.0), (5, 0.5)]
    rows, seen = [], {}
    for q, s in data:
        seen[q] = seen.get(q, 0) + 1
        rows.append((q, seen[q], s, f"a{seen[q]}"))
    return spark.createDataFrame(rows, "qid int, rank int, score double, artifact_id string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(q,) for q in (1, 2, 3, 4, 5)], "qid int")


def test_selectors(hits, rows):
    assert rows(selection.rel_threshold(hits, 0.91), "qid", "rank") == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (5, 1)]
    assert rows(selection.score_gap(hits, 0.5), "qid", "rank") == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (5, 1), (5, 2)]
    assert rows(selection.abs_threshold(hits, 0.95), "qid", "rank") == [(1, 1), (1, 2), (5, 1)]
    assert len(rows(selection.top_k(hits, 1))) == 4


def test_conservative(hits, asked):
    by = {r.qid: r for r in selection.conservative(hits, asked, max_k=2, min_score=0.3).collect()}
    assert (by[1].selected, by[1].reason, by[1].n_selected) == ("a1|a2", "max_k", 2)
    assert (by[2].reason, by[2].selected) == ("single", "a1")
    assert by[3].reason == "abstain:below_floor" and by[4].reason == "abstain:no_candidates" and by[4].abstained
    assert by[5].reason == "rel_threshold"
    assert {r.qid: r.reason for r in selection.conservative(hits, asked).collect()}[3] == "nonpositive_top"


def test_dedup_miss_callable_and_disclosure(spark, hits, asked, rows):
    keyed = hits.withColumn("name", F.when(F.col("rank") < 3, "same"))
    assert rows(selection.dedup_by(keyed, "name"), "qid", "rank") == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (5, 1)]
    texts = hits.withColumn("text", F.when(F.col("rank") == 1, "It falls  back.").otherwise("never"))
    miss = {r.qid: r for r in selection.lexical_miss(texts, asked, ["falls back", "never"], top_hits=1).collect()}
    assert miss[4].zero_hits and miss[1].missing_required == "never" and miss[1].missing_in_candidates == ""
    chosen = selection.by_callable(hits.withColumn("qid", F.col("qid").cast("bigint")), lambda qid, cands: [c[1] for c in cands][-1:])
    assert (1, "a4") in rows(chosen)
    bodies = spark.createDataFrame([("p1", "x" * 30_000)], "pointer string, body string")
    shown = selection.disclose(hits.withColumn("pointer", F.concat(F.lit("p"), "rank")), bodies, "bundled").where("qid = 1").orderBy("rank").collect()
    assert (len(shown[0].body), shown[0].note, shown[1].note) == (20_000, "truncated", "pointer_unreadable")
    with pytest.raises(ValueError):
        selection.disclose(hits, bodies, "all")


def test_federated_reasons(spark):
    hits = spark.createDataFrame([(1, "x", "a", 0.1, 0), (1, "y", "b", 0.1, 1), (2, "x", "a", 0.1, 0), (2, "y", "b", 0.9, 1)], "qid int, source string, artifact_id string, score double, pos int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    by = {r.qid: r for r in selection.federated(hits, asked, {"x": 0.5, "y": 0.5}).collect()}
    assert by[1].reason == "abstain:all_sources_below_floor" and by[2].selected == "b" and by[3].reason == "abstain:no_candidates"


RECORDS = [("r0", "chunk", 0, "abcdefgh12345678"), ("r1", "chunk", 1, "12345678xyz"), ("r2", "note", 2, "xyz-note"), ("r3", "chunk", 4, "end")]


def test_expand(spark):
    records = spark.createDataFrame([(i, "s", "a", k, n, t) for i, k, n, t in RECORDS], "record_id string, source string, artifact_id string, surface_kind string, surface_index int, text string")
    hits = records.where("record_id = 'r1'").withColumn("qid", F.lit(1)).unionByName(records.where("record_id = 'r1'").withColumn("record_id", F.lit("gone")).withColumn("artifact_id", F.lit("b")).withColumn("qid", F.lit(2)))
    parent = {r.qid: r for r in expansion.expand(hits, records, "parent").collect()}
    assert parent[1].passage == "abcdefgh12345678xyz\n\nxyz-note\n\nend" and parent[1].record_ids == "r0|r1|r2|r3"
    assert parent[2].passage == "12345678xyz" and parent[2].n_records == 0
    window = {r.qid: r for r in expansion.expand(hits, records, "window", 1).collect()}
    assert window[1].record_ids == "r0|r1|r3"
    with pytest.raises(ValueError):
        expansion.expand(hits, records, "x")


def test_reasons_of_the_conservative_choice(spark):
    def chosen(scores, **kw):
        hits = spark.createDataFrame([(1, k + 1, float(x), f"a{k}") for k, x in enumerate(scores)], "qid int, rank int, score double, artifact_id string")
        r = selection.conservative(hits, spark.createDataFrame([(1,)], "qid int"), **kw).first()
        return r.reason, r.n_selected, r.min_ratio

    assert chosen([1.0, 0.95, 0.9]) == ("exhausted", 3, 0.9)
    assert chosen([1.0, 0.95, 0.9, 0.9]) == ("max_k", 3, 0.9)
    assert chosen([1.0, 0.5, 0.4, 0.3]) == ("rel_threshold", 1, 1.0)
    assert chosen([-1.0]) == ("single", 1, 1.0) and chosen([0.0, -1.0]) == ("nonpositive_top", 1, 1.0)
    assert chosen([0.5], min_score=0.9) == ("abstain:below_floor", 0, None)


def test_a_failing_chooser_falls_back(spark, rows):
    hits = spark.createDataFrame([(q, k + 1, s, f"a{k}") for q in (1, 2, 3) for k, s in enumerate((1.0, 0.95, 0.2))], "qid bigint, rank int, score double, artifact_id string")

    def chooser(qid, candidates):
        if qid == 1:
            raise RuntimeError("no answer")
        return ["unknown"] if qid == 2 else ["a2", "unknown"]

    assert rows(selection.by_callable(hits, chooser)) == [(1, "a0"), (1, "a1"), (2, "a0"), (2, "a1"), (3, "a2")]
