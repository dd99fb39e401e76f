import random
from collections import defaultdict

import pytest

from corpusmill.llm import splitting, topn

TEXTS = ["word " * 700, "x" * 5000, "Eine Sätze. " * 300, "第一句。第二句!" * 400, "para one.\n\n" * 300, "a, b; c: " * 500, "line\r\n" * 600, "é" * 1201, "mixed 🙂 text. " * 200, ("s. " * 100 + "y" * 900) * 5]


def check(text, spans, limit, overlap):
    at = 0
    for i, (a, b) in enumerate(spans):
        assert 0 < b - a <= limit
        assert text[at:a].strip() == ""  # nothing but white space is skipped
        if i:
            assert a > spans[i - 1][0] and spans[i - 1][1] - a <= overlap
        at = max(at, b)
    assert text[at:].strip() == ""


@pytest.mark.parametrize("limit, overlap", [(1200, 200), (100, 0), (60, 25)])
def test_pieces_cover_and_fit(limit, overlap):
    for t in TEXTS:
        check(t.strip(splitting.OUTER), splitting.spans_of(t.strip(splitting.OUTER), limit, overlap), limit, overlap)


def test_natural_boundaries():
    t = ("One sentence here. " * 100).strip()
    assert all(t[b - 1] == "." for _, b in splitting.spans_of(t))
    p = ("First. Second.\n\n" * 120).strip()
    spans = splitting.spans_of(p)
    assert all(p[b : b + 2] == "\n\n" for _, b in spans[:-1]) and all(p[a : a + 5] in ("First", "Secon") for a, _ in spans)


@pytest.mark.parametrize("range_chars", [1200, 1500, 4096])
def test_ranges_give_the_same_pieces_as_one_text(spark, range_chars):
    df = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(TEXTS)], "id string, text string")
    whole = splitting.split_texts(df, ["id"], range_chars=10**6)
    cut = splitting.split_texts(df, ["id"], range_chars=range_chars)
    got = [{(r.id, r.piece_no, r.start, r.end): r.piece for r in d.collect()} for d in (whole, cut)]
    assert got[0] == got[1]
    assert all(len(p) == e - s for (_, _, s, e), p in got[1].items())


def test_edges_of_the_input(spark, rows):
    data = [("null", None, 1), ("empty", "", 1), ("blank", " \n" * 900, 1), ("limit", " " + "a" * 1200 + "\n", 1), ("over", "a" * 1201, 1), ("over", "a" * 1201, 1), (None, "b " * 900, 1), ("two", "c " * 900, 1), ("two", "d " * 900, 2)]
    df = spark.createDataFrame(data, "id string, text string, piece int")  # an extra column of the result's name
    got = splitting.split_texts(df, ["id"])
    assert rows(got.select("id").distinct()) == [("over",), ("two",), (None,)]
    assert got.where("id = 'over'").count() == 2 and got.where("id = 'two' AND piece_no = 0").count() == 2
    assert rows(splitting.split_texts(df, ["id"], range_chars=1300).where("id IS NULL").select("piece_no")) == [(0,), (1,)]
    assert splitting.split_texts(df.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, ["id"], limit=100, overlap=100)


@pytest.mark.parametrize("range_bytes", [2000, 5000, 1 << 20])
def test_giant_files_by_byte_range(spark, tmp_path, range_bytes):
    text = "".join(TEXTS[2:4] + TEXTS[7:9]) * 2
    (tmp_path / "big.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "none.txt").write_text("")
    got = splitting.split_files(spark, [str(tmp_path / "big.txt"), str(tmp_path / "none.txt")], range_bytes=range_bytes).orderBy("piece_no").collect()
    spans = [(r.start, r.end) for r in got]
    check(text, spans, 1200, 200)
    assert [r.piece for r in got] == [text[a:b] for a, b in spans]
    assert spans == splitting.spans_of(text)


# --- top n ---------------------------------------------------------------------------------------

SCHEMA = "g string, h string, score double, id int, extra string"


def brute(data, n):
    groups = defaultdict(dict)
    for g, h, s, i, _ in data:
        if s is not None and s == s:
            s = s + 0.0
            best = groups[g, h].get(i)
            groups[g, h][i] = s if best is None else max(best, s)
    out = set()
    for key, ids in groups.items():
        order = sorted(ids.items(), key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out |= {(*key, i, r + 1) for r, (i, _) in enumerate(order[:n])}
    return out


@pytest.mark.parametrize("n, batch", [(1, 7), (3, 5), (3, 10_000)])
def test_top_n_against_brute_force(spark, n, batch):
    rng = random.Random(n)
    data = [(rng.choice(["hot", "hot", "a", None]), rng.choice(["x", None]), rng.choice([None, float("nan"), 0.5, 0.5, 0.7, -1.0, 0.0, -0.0]), rng.choice([*range(25), None]), "e") for _ in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(data + data[:50], SCHEMA).repartition(5)
        got = {tuple(r) for r in topn.top_n(df, ["g", "h"], "score", "id", n).select("g", "h", "id", "rank").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(data, n)


def test_top_n_empty_clash_and_columns(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 1, "kept")], SCHEMA)
    assert topn.top_n(df.limit(0), ["g"], "score", "id", 3).count() == 0
    assert topn.top_n(df, ["g"], "score", "id", 3).first().extra == "kept"
    with pytest.raises(ValueError):
        topn.top_n(df.withColumnRenamed("extra", "Rank"), ["g"], "score", "id", 3)
    renamed = df.withColumnRenamed("extra", "__score")
    assert topn.top_n(renamed, ["g"], "score", "id", 3, rank="place").first().asDict()["__score"] == "kept"


# --- ranges --------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1200, 1777, 4096])
def test_tables_hand_the_place_on(size):
    """Stitched tables give the pieces of the text cut as one, from every place a piece can begin first."""
    for t in TEXTS:
        t = t.strip(splitting.OUTER)
        place, number, got = 0, 0, []
        for at, r in splitting.ranges_of(t, 1200, 200, size):
            exits, counts = r.table()
            for first in (0, 1, 57, 600, 1199):
                spans, following = r.spans(first)
                assert (exits[first], counts[first]) == (-1 if following is None else following, len(spans))
            if place >= 0:
                got += [(at + a, at + b) for a, b in r.spans(place)[0]]
                number, place = number + counts[place], exits[place]
        assert got == splitting.spans_of(t) and number == len(got) and place == -1


def test_rows_that_are_spread_give_the_same_pieces(spark):
    df = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0])], "id string, text string")
    near = splitting.split_texts(df, ["id"])
    spread = splitting.split_texts(df, ["id"], spread_chars=1300)
    got = [sorted((str(r.id), r.piece_no, r.start, r.end, r.piece) for r in d.collect()) for d in (near, spread)]
    assert got[0] == got[1] and len(got[0]) > 30
