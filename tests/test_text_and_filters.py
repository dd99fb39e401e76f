from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.functions.text import mentions
from corpusmill.operators import filters, surfaces


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_scalars(spark):
    assert one(spark, fn.tokens(F.col("t")), t="Über_x, naïve-3!") == ["über_x", "naïve", "3"]
    assert one(spark, fn.tokens(F.col("t")), t=None) == []
    assert one(spark, fn.dist_name(F.col("t")), t=" Foo_.Bar[x]>=1") == "foo-bar"
    assert one(spark, fn.slug(F.col("t")), t="--A b/C--") == "a-b-c"
    assert one(spark, fn.sigmoid(F.lit(float("nan")))) == 0.0
    assert one(spark, fn.sigmoid(F.lit(1e9))) == pytest.approx(1.0)
    assert one(spark, fn.mentions(F.col("t"), F.lit("falls back")), t="it Falls\n back.") is True
    assert one(spark, fn.mentions(F.col("t"), F.lit("fall")), t="falls") is False
    assert one(spark, fn.longest_overlap(F.col("a"), F.col("b")), a="xx 12345678", b="12345678 yy") == 8
    assert one(spark, fn.longest_overlap(F.col("a"), F.col("b")), a="1234567", b="1234567") == 0
    assert one(spark, fn.recency(F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 11)), 10)) == pytest.approx(0.5)


def test_fold(spark):
    assert fn.fold_string("Čafé ĐØ ΆΒ й ﬁ") == "cafe do αβ й fi"
    assert one(spark, fn.fold_text(F.col("t")), t="ÀB") == "ab" and one(spark, fn.fold_text(F.col("t")), t=None) is None


def test_intervals():
    assert fn.parse_every("15m") == timedelta(minutes=15) and fn.parse_every("daily") == timedelta(days=1)
    assert fn.format_every(timedelta(hours=36)) == "36h"
    with pytest.raises(ValueError):
        fn.parse_every("0h")


@pytest.mark.parametrize(
    "spec, ids",
    [
        ({}, {1, 2, 3}), ({"p": "a"}, {1}), ({"p": {"$ne": "a"}}, {2, 3}), ({"p": {"$nin": ["a"]}}, {2, 3}), ({"p": {"$in": ["a", "b"]}}, {1, 2}), ({"n": {"$gt": 1, "$lte": 3}}, {2}),
        ({"p": {"$exists": False}}, {3}), ({"$not": {"p": "a"}}, {2, 3}), ({"$or": [{"p": "a"}, {"n": {"$gte": 2}}]}, {1, 2}), ({"$and": [{"p": "a"}, {"n": 2}]}, set()), ({"p": None}, {3}),
    ],
)
def test_filters(spark, spec, ids):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, None)], "id int, p string, n int")
    assert {r.id for r in df.where(filters.compile_filter(spec)).collect()} == ids


@pytest.mark.parametrize("spec", [{"p": {"$regex": "x"}}, {"$and": {"p": 1}}, {"$nor": []}, {"p": {"$in": "ab"}}, {"$or": []}])
def test_filters_that_raise(spec):
    with pytest.raises(ValueError):
        filters.compile_filter(spec)


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("kind", F.lit("a")).write.parquet(path)
    plan = spark.read.parquet(path).where(filters.compile_filter({"id": {"$gte": 5}}))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,5)]" in plan


def pack(text, size, overlap):
    """The packer, said again in Python."""
    import re

    text = (text or "").strip(" \t\r\n")
    if not text:
        return []
    if len(text) <= size:
        return [text]
    done, cur = [], ""
    for p in (q for q in (x.strip(" \t\r\n") for x in re.split(r"\n\s*\n", text)) if q):
        if len(p) > size:
            done += [cur] * bool(cur)
            cur = ""
            done += [p[i : i + size] for i in range(0, len(p), max(1, size - overlap)) if p[i : i + size].strip(" \t\r\n")]
        elif len(cur + "\n\n" + p if cur else p) <= size:
            cur = cur + "\n\n" + p if cur else p
        else:
            carried = (cur[-overlap:] + "\n\n" + p).strip(" \t\r\n") if cur and overlap else p
            done += [cur] * bool(cur)
            cur = carried  # what is carried on is kept whole, beyond the size too
    return done + [cur] * bool(cur)


@pytest.mark.parametrize("size, overlap", [(30, 6), (30, 0), (50, 20)])
def test_chunks_against_python(spark, size, overlap):
    texts = ["", None, "  ", "short", "a b c\n\n" * 9, "x" * 130 + "\n\ntail words here", "one two three four\n\nfive six seven\n \neight nine ten eleven twelve\n\n" + "y" * 40 + "\n\nend"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.c for r in df.select("id", surfaces.chunks(F.col("text"), size, overlap).alias("c")).collect()}
    assert got == {k: pack(t, size, overlap) for k, t in enumerate(texts)}


@pytest.mark.parametrize("n, size, overlap", [(0, 10, 2), (5, 10, 2), (10, 10, 2), (11, 10, 2), (95, 10, 3), (101, 25, 0)])
def test_balanced_windows(spark, n, size, overlap):
    text = "".join(chr(97 + k % 26) for k in range(n))
    got = one(spark, surfaces.balanced_windows(F.col("t"), size, overlap), t=text)
    assert len(got) == surfaces.windows_needed(n, size, overlap) and all(len(w) <= size for w in got)
    joined = got[0] if got else ""
    for w in got[1:]:
        joined += w[overlap:]
    assert joined.startswith(text) or text == joined


def test_strategy_specs_round_trip(spark):
    nested = surfaces.WithSynopsis(surfaces.Fields(("a", "b"), head=("t",)), gate="thin")
    assert surfaces.strategy_from_spec(nested.spec()) == nested and nested.id == surfaces.strategy_from_spec(nested.spec()).id
    with pytest.raises(ValueError):
        surfaces.strategy_from_spec({"class": "Nope"})


def test_blank_surfaces_are_not_numbered(spark, rows):
    df = spark.createDataFrame([("p", "", "", ["numpy", "numpy"]), ("q", "does", "r" * 10, None)], "name string, description string, readme string, deps array<string>")
    got = rows(surfaces.Package(embed_deps=True).decompose(df, ["name"]), "name", "surface_index", "surface_kind", "text")
    assert got == [("p", 0, "deps", "Depends on: numpy"), ("q", 0, "description", "q: does"), ("q", 1, "readme_chunk", "r" * 10)]


def test_a_paragraph_keeps_what_is_carried_on(spark):
    df = spark.createDataFrame([("p" * 900 + "\n\n" + "q" * 1100 + "\n\n" + "r" * 300,)], "text string")
    assert [len(c) for c in df.select(surfaces.chunks(F.col("text"))).first()[0]] == [900, 1302, 502]


def test_balanced_windows_are_of_the_stripped_text(spark):
    df = spark.createDataFrame([("   " + "x" * 1198 + "   ",), ("a" * 11,), (" \n ",), (None,)], "text string")
    assert [len(w) for w in df.select(surfaces.balanced_windows(F.col("text"), 1200, 200)).first()[0]] == [1198]
    assert [r[0] and [len(w) for w in r[0]] for r in df.select(surfaces.balanced_windows(F.col("text"), 10)).collect()][1:3] == [[6, 5], []]


def test_mentions_want_white_space(spark):
    cases = [("It Falls  back\nto.", True), ("falls-back to", False), ("falls, back to", False), ("it pitfalls back to", False), ("falls back total", False), (None, False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(mentions(F.col("t"), F.lit("falls back  to"))).collect()] == [y for _, y in cases]
    assert df.select(mentions(F.lit("a c++ (x) tool"), F.lit("C++ (X)"))).first()[0] and not df.select(mentions(F.lit("a"), F.lit("  "))).first()[0]


def test_a_synthesizer_is_part_of_the_strategy(spark):
    plain, upper = surfaces.WithSynopsis(surfaces.WholeText()), surfaces.WithSynopsis(surfaces.WholeText(), synthesizer="pyspark.sql.functions:upper")
    assert plain.id != upper.id and surfaces.strategy_from_spec(upper.spec()) == upper
    df = spark.createDataFrame([("One. Two.",)], "text string")
    assert [r.text for r in upper.decompose(df, []).collect()] == ["ONE. TWO.", "One. Two."] and plain.decompose(df, []).first().text == "One."
