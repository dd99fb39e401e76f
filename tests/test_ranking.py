import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ranking, search
from corpusmill.operators.embedding import hashed

DOCS = {"d1": "red apple pie", "d2": "green apple", "d3": "zq17 token stream red red", "d4": "blue sky", "d5": ""}


@pytest.fixture
def corpus(spark):
    rows = [(k, "s", k[0], "document" if k != "d2" else "synopsis", i, t) for i, (k, t) in enumerate(DOCS.items())]
    return spark.createDataFrame(rows, "record_id string, source string, artifact_id string, surface_kind string, surface_index int, text string")


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "red apple"), (2, "nothing here"), (3, "")], "qid bigint, text string")


def okapi(query, docs, k1=1.5, b=0.75):
    toks = {k: t.lower().split() for k, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for k, t in toks.items():
        c = Counter(t)
        s = 0
        for w in set(query.split()):
            df = sum(w in x for x in toks.values())
            if c[w]:
                s += math.log1p((n - df + 0.5) / (df + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(t) / avg))
        if any(c[w] for w in query.split()):
            out[k] = round(s, 9)
    return out


@pytest.mark.parametrize("bound", [500_000, 0])
def test_bm25_against_formula(spark, corpus, asked, monkeypatch, bound):
    monkeypatch.setattr(ranking, "BROADCAST_TERMS", bound)
    got = {(r.qid, r.record_id): r.score for r in ranking.bm25(corpus, asked).collect()}
    want = {(1, k): s for k, s in okapi("red apple", DOCS).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_filter_changes_statistics(corpus, asked):
    every = ranking.bm25(corpus, asked).where("record_id = 'd1'").first().score
    some = ranking.bm25(corpus.where("record_id <> 'd3'"), asked).where("record_id = 'd1'").first().score
    assert some != every


def test_cosine_blocks_ties_and_unusable(spark, rows, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = [(k, rng.standard_normal(4).astype("f4").tolist()) for k in range(60)]
    vectors += [(100, vectors[0][1]), (101, [0.0] * 4), (102, None), (103, [1.0]), (104, [float("nan"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vectors, "record_id int, vector array<float>").repartition(3)
    q = df.where("record_id < 5 OR record_id > 100").select(F.col("record_id").alias("qid"), F.col("vector").alias("qvec"))
    m = {k: np.array(v, "f8") for k, v in vectors if k <= 100}
    want = set()
    for i in range(5):
        s = sorted((-round(float(m[i] @ m[j] / np.linalg.norm(m[i]) / np.linalg.norm(m[j])), 9), j) for j in m)
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(s[:7])}
    for block in (4096, 2):
        monkeypatch.setattr(ranking, "QUERY_BLOCK", block)
        assert set(rows(ranking.cosine(df, q, 7, 4), "qid", "record_id", "rank")) == want


def test_sparse_cosine_of_a_text_with_itself(corpus, rows):
    same = corpus.where("record_id = 'd1'").select(F.lit(1).alias("qid"), "text")
    got = ranking.sparse_cosine(hashed(corpus, "record_id", "text"), hashed(same, "qid", "text"), 1).first()
    assert (got.record_id, got.score) == ("d1", 1.0)


def ranked(spark, *rows):
    return spark.createDataFrame(rows, "qid int, record_id string, score double, rank int")


def test_fusion_formulas(spark):
    dense = ranked(spark, (1, "a", 0.8, 1), (1, "b", 0.6, 2), (2, "a", 0.3, 1))
    lexical = ranked(spark, (1, "b", 8.0, 1), (1, "c", 24.0, 2))
    rrf = {(r.qid, r.record_id): r.score for r in ranking.rrf(dense, lexical).collect()}
    assert rrf[1, "b"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8) and rrf[2, "a"] == 0.3
    blend = {(r.qid, r.record_id): r.score for r in ranking.blend(dense, lexical).collect()}
    assert blend[1, "a"] == 0.4 and blend[1, "b"] == pytest.approx(0.3 + 0.25) and blend[1, "c"] == pytest.approx(0.375)
    with pytest.raises(ValueError):
        ranking.blend(dense, lexical, alpha=2)


def test_weights_before_the_cut(corpus, asked):
    plain = search.search(corpus, asked, mode="lexical", k=1, per_artifact=False)
    weighed = search.search(corpus, asked, mode="lexical", k=1, per_artifact=False, surface_weights={"synopsis": 10.0})
    assert plain.first().record_id == "d1" and weighed.first().record_id == "d2"
    with pytest.raises(ValueError):
        search.search(corpus, asked, surface_weights={"x": -1.0})


def test_collapse_rerank_boost_and_arguments(spark, corpus, asked):
    one = search.search(corpus, asked, mode="lexical").collect()
    assert len(one) == 1 and one[0].rank == 1  # all share one artifact
    again = search.search(corpus, asked, mode="lexical", per_artifact=False, rerank=lambda q, p: F.length(p).cast("double")).collect()
    assert [r.record_id for r in sorted(again, key=lambda r: r.rank)][0] == "d3"
    with_deps = corpus.withColumn("deps", F.when(F.col("record_id") == "d3", F.array(F.lit("numpy"))))
    boosted = search.search(with_deps, asked, mode="lexical", per_artifact=False, dep_boost={"libs": ["numpy"], "weight": 9.0}).where("rank = 1").first()
    assert boosted.record_id == "d3"
    for bad in ({"mode": "x"}, {"fusion": "x"}, {"k": 0}):
        with pytest.raises(ValueError):
            search.search(corpus, asked, **bad)
    assert search.search(corpus.limit(0), asked).count() == 0


def test_demote_and_merge(spark, rows):
    hits = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "a", 2.0), (1, 1, "b", -1.0)], "qid int, variant int, record_id string, score double")
    assert rows(ranking.merge_variants(hits, 0.5), "record_id", "score") == [("a", 1.0), ("b", -1.5)]


def test_fuse_hits(spark, rows):
    hits = spark.createDataFrame(
        [(1, "x", "a", 0.9, 0), (1, "x", "b", 0.8, 0), (1, "y", "a", 0.1, 1), (2, "x", "a", 0.7, 0)], "qid int, source string, artifact_id string, score double, pos int"
    )
    fused = {(r.qid, r.source, r.artifact_id): r for r in ranking.fuse_hits(hits).collect()}
    assert fused[1, "x", "a"].score == pytest.approx(1 / 61, abs=1e-8) and fused[2, "x", "a"].score == 0.7
    by_id = ranking.fuse_hits(hits.where("qid = 1"), identity="artifact_id").where("rank = 1").first()
    assert (by_id.artifact_id, by_id.fused_sources) == ("a", "x,y") and by_id.score == pytest.approx(2 / 61, abs=1e-8)


def test_blend_without_one_channel_keeps_the_other(spark, rows):
    kind = "qid int, record_id string, score double, rank int"
    dense = spark.createDataFrame([(1, "a", 0.8, 1), (2, "a", 0.6, 1)], kind)
    lexical = spark.createDataFrame([(2, "a", 8.0, 1), (3, "b", 5.0, 1)], kind)
    assert rows(ranking.blend(dense, lexical), "qid", "record_id", "score") == [(1, "a", 0.8), (2, "a", 0.55), (3, "b", 5.0)]


def test_boost_by_normalised_names(spark, rows):
    hits = spark.createDataFrame([(1, "a", 0.4, ["NetworkX>=3", "networkx"]), (1, "b", 0.45, ["anyio"]), (1, "c", 0.1, None)], "qid int, record_id string, score double, deps array<string>").withColumn("rank", F.lit(1))
    assert rows(ranking.boosted(hits, F.array(F.lit("networkx")), F.col("deps"), 0.1), "record_id", "score", "rank") == [("a", 0.5, 1), ("b", 0.45, 2), ("c", 0.1, 3)]
    for bad in ((float("nan"), 1), (0.1, 0)):
        with pytest.raises(ValueError):
            ranking.boosted(hits, F.array(F.lit("x")), F.col("deps"), *bad)
