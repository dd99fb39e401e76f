import random

from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.plans import seams


def brute(left, right, least=8):
    return next((n for n in range(min(len(left), len(right)), least - 1, -1) if left.endswith(right[:n])), 0)


def test_overlap_against_brute_force():
    draw = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(draw.choice("aab") for _ in range(draw.randrange(25))) for _ in range(2))
        assert fn.overlap_length(a, b, 3) == brute(a, b, 3)


def test_overlap_beyond_4000_characters(spark):
    shared = "".join(f"{i} " for i in range(2000))
    df = spark.createDataFrame([(1, "before " + shared, shared + "after"), (2, shared, shared), (3, None, shared), (4, "ü" * 9000, "ü" * 7000 + "x")], "id int, a string, b string")
    got = {r.id: r.n for r in df.select("id", fn.longest_overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    assert len(shared) > 4000 and got == {1: len(shared), 2: len(shared), 3: 0, 4: 7000}


def test_rerank_passages_up_to_2000_characters(spark, tmp_path):
    records = [(f"{a}{i}", "s", a, "chunk", 2 * i, "chunk", f"needle {a} " + "x" * 600, i) for a, n in (("short", 2), ("long", 5)) for i in range(n)]
    spark.createDataFrame(records, "record_id string, source string, artifact_id string, surface_kind string, surface_index int, granularity string, text string, ingested_at int").write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame([(1, "short", "en"), (2, "long", "en")], "item_id int, text string, lang string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.qid, r.n) for r in seams.rerank_artifact_text(spark, str(tmp_path)).collect()}
    assert got == {(1, 2 * len("needle short ") + 2 * 600 + 2), (2, 2000)}
