import hashlib

from corpusmill.operators import evaluation as ev
from corpusmill.plans import evaluation as plans


def curve(scope, scores, gold, sizes, trials):
    """One catalogue at a time, from the whole scope."""
    out = {}
    for size in sorted({min(s, len(scope)) for s in sizes}):
        hits = []
        for q, g in gold.items():
            for t in range(1 if size == len(scope) else trials):
                others = sorted((a for a in scope if a != g), key=lambda a: (hashlib.sha256(f"0/{t}/{a}".encode()).hexdigest(), a))[: size - 1]
                hits.append(all(scores.get((q, a), 0.0) < scores.get((q, g), 0.0) for a in others))
        out[size] = (round(sum(hits) / len(hits), 9), len(hits))
    return out


def check(spark, scope, scores, gold, sizes, trials):
    ids = spark.createDataFrame([(a,) for a in scope], "artifact_id long")
    got = ev.distractor_curve(
        spark.createDataFrame([(q, a, s) for (q, a), s in scores.items()], "qid int, artifact_id long, score double"),
        spark.createDataFrame(list(gold.items()), "qid int, artifact_id long"), ev.draw_distractors(ids, sizes, trials), sizes,
    )
    assert {r.size: (r.accuracy, r.n) for r in got.collect()} == curve(scope, scores, gold, sizes, trials)


def test_curve_against_python(spark):
    """Scores for a few artifacts only, a gold artifact without a score, scopes of more, as many and fewer than the largest size."""
    for n in (60, 16, 11):
        scores = {(q, a): float((a * 7 + q * 5) % 13 - (a % 2)) for q in (1, 2) for a in range(n) if (a + q) % 3} | {(1, 4): 11.5}
        check(spark, list(range(n)), scores, {1: 4, 2: 7, 3: 9}, (1, 4, 8, 16), 5)


def test_query_draws_from_all_documents(spark, tmp_path):
    """400 documents of which 30 have terms of the passage: nine in ten distractors have no score and lose against a gold document that has one."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    docs = [(i, " ".join(words) if i == 0 else " ".join(words + words) if i < 30 else f"other{i} text{i}") for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words), "en")], "item_id int, text string, lang string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.size: (r.accuracy, r.n) for r in plans.distractor_curve(spark, str(tmp_path)).collect()}
    # documents 1 to 29 hold the words twice and beat document 0, the gold one with the least id; nobody else does
    scores = {(1, 0): 1.0} | {(1, i): 2.0 for i in range(1, 30)}
    assert got == curve(list(range(400)), scores, {1: 0}, (1, 4, 8, 16, 32, 64, 128), 20) and 0 < got[8][0] < 1
