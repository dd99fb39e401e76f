import numpy as np
import pytest

from corpusmill.llm import leakage, neighbours

SCHEMA = "record_id string, vector array<float>, ingested_at int"


def brute(vectors, k, floor):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids], "f8")
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(ids):
        s = sorted((-float(m[a] @ m[b]), j) for b, j in enumerate(ids) if j != i)
        out[i] = [(j, -c) for c, j in s[:k] if -c >= floor]
    return out


def test_recall_and_exact_cosines(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 16))
    vectors = {f"v{k:04d}": base[k].astype("f4").tolist() for k in range(400)}
    for k in range(120):  # near twins
        vectors[f"w{k:04d}"] = (base[k] * 3 + rng.standard_normal(16) * 0.3).astype("f4").tolist()
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA).repartition(4)
    want = brute(vectors, 5, 0.95)
    got = {}
    for r in neighbours.nearest(df, dim=16, min_cosine=0.95, axes=8).collect():
        got.setdefault(r.record_id, []).append((r.neighbour, r.cosine))
    pairs = {(i, j) for i, l in want.items() for j, _ in l}
    hit = {(i, j) for i, l in got.items() for j, _ in l}
    assert len(hit & pairs) >= 0.98 * len(pairs) and hit <= pairs
    truth = {(i, j): c for i, l in want.items() for j, c in l}
    assert all(c == pytest.approx(truth[i, j], abs=1e-6) for i, l in got.items() for j, c in l)


def test_copies_ties_and_unusable_rows(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.2, 0.0]
    rows = [(f"c{k:02d}", a, 0) for k in range(9)] + [("d", b, 0), ("d", b, 5), ("redelivered", a, 0), ("redelivered", b, 1)]
    rows += [("null", None, 0), ("zero", [0.0] * 4, 0), ("short", [1.0], 0), ("nan", [float("nan"), 1.0, 1.0, 1.0], 0), ("inf", [float("inf"), 1.0, 1.0, 1.0], 0), (None, a, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", rank string")
    got = {}
    for r in neighbours.nearest(df, k=3, dim=4, axes=4, min_cosine=0.9).collect():
        got.setdefault(r.record_id, {})[r.rank] = (r.neighbour, round(r.cosine, 6))
    assert got["c00"] == {1: ("c01", 1.0), 2: ("c02", 1.0), 3: ("c03", 1.0)}
    assert got["c08"] == {1: ("c00", 1.0), 2: ("c01", 1.0), 3: ("c02", 1.0)}
    assert got["d"] == {1: ("redelivered", 1.0)} and set(got) == {*(f"c{k:02d}" for k in range(9)), "d", "redelivered"}
    assert neighbours.nearest(df.limit(0), dim=4, axes=4).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest(df, axes=30, bits=4)


def test_all_neighbours_without_a_floor(spark):
    rng = np.random.default_rng(2)
    vectors = {f"v{k}": rng.standard_normal(8).astype("f4").tolist() for k in range(60)}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA)
    want = {(i, j) for i, l in brute(vectors, 5, -2).items() for j, _ in l}
    got = {(r.record_id, r.neighbour) for r in neighbours.nearest(df, dim=8, axes=6).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_hilbert_curve_visits_every_cell_once_stepwise():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    keys = neighbours.hilbert_keys(grid, 4)
    assert sorted(keys.tolist()) == list(range(256))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# --- leaked test items ---------------------------------------------------------------------------

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
W = ITEM.split()


def longest_shared(doc, item):
    a, b = leakage.words_of(doc), leakage.words_of(item)
    return max([0, *(n for n in range(1, len(b) + 1) for i in range(len(b) - n + 1) if any(a[j : j + n] == b[i : i + n] for j in range(len(a) - n + 1)))])


DOCS = {
    "whole": "before " + ITEM + " after", "exact13": "x " + " ".join(W[2:15]) + " y", "twelve": "x " + " ".join(W[2:14]) + " y", "tags": "<p>" + " <br/> ".join(w.upper() for w in W) + "</p>",
    "marks": ", ".join(W).replace("five", "**five**") + "!", "lines": "\n> ".join(W), "broken": " ".join(W[:7] + ["zzz"] + W[8:]), "null": None, "empty": "", "short": "one two", "twice": ITEM + " " + ITEM,
}


@pytest.mark.parametrize("bound", [leakage.SEED_BOUND, 0])
def test_leaks_by_broadcast_and_by_join(spark, bound):
    docs = spark.createDataFrame([(k, t, 1) for k, t in DOCS.items()] + [("whole", DOCS["whole"], 1)], "doc_id string, text string, stretch int")
    items = spark.createDataFrame([(7, ITEM), (8, "unrelated words only here and nothing else to be found at all"), (9, None), (7, ITEM)], "item_id int, text string")
    got = {r.doc_id: r for r in leakage.leaked(docs, items, seed_bound=bound).collect()}
    exact = {k for k, r in got.items() if r.exact_run >= 13}
    assert exact == {k for k, t in DOCS.items() if t and longest_shared(t, ITEM) >= 13} == {"whole", "exact13", "tags", "marks", "lines", "twice"}
    assert got["broken"].matched == 15 and got["broken"].stretch == 16 and got["broken"].exact_run == 8
    assert all(r.item_id == 7 for r in got.values()) and "twelve" not in got
    assert leakage.leaked(docs.limit(0), items, seed_bound=bound).count() == 0 and leakage.leaked(docs, items.limit(0), seed_bound=bound).count() == 0


def test_any_single_replacement_in_a_window_still_hits():
    index = leakage.SeedIndex([(0, W[:13])])
    for k in range(13):
        doc = [*W[:k], "other", *W[k + 1 : 13]]
        h = np.fromiter((leakage._hashes[w] for w in doc), np.uint64, 13)
        assert (0, 0) in index.hits(h)


def test_lists_are_refined(spark):
    """Two rows that stand in a third one's list become candidates of each other, if they better their own lists."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(8)
    vectors = {k: base + 0.05 * rng.standard_normal(8) for k in "abc"} | {"z": -base}
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id string, vector array<float>")
    lists = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("a", "z", -0.9), ("b", "z", -0.9), ("c", "z", -0.9)], "a string, b string, approx float")
    got = neighbours._refined(lists, neighbours._codes_of(rows, 8), 1, 8).collect()
    assert {(r.a, r.b) for r in got} == {("b", "c")} and got[0].approx > 0.9
    assert neighbours._refined(lists.limit(0), neighbours._codes_of(rows, 8), 1, 8).count() == 0
