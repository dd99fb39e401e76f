import random
from datetime import datetime, timedelta

import pytest

from corpusmill.operators import hierarchy, skew

LINKS = "source string, artifact_id string, edge_type string, pos int, target_source string, target_id string, written_at timestamp"
T0 = datetime(2024, 1, 1)


def link(child, parent, at=0, source="s", kind="PARENT"):
    return (source, child, kind, 0, None, parent, None if at is None else T0 + timedelta(hours=at))


def brute(links):
    parents = {}
    for source, child, kind, _, _, target, at in links:
        if kind == "PARENT" and target and child and source is not None:
            key, rank = (source, child), (at or datetime.min, target)
            if key not in parents or rank > parents[key][0]:
                parents[key] = (rank, target)
    out = set()
    for source, child in parents:
        at, seen = child, []
        while (source, at) in parents and parents[source, at][1] not in seen:
            at = parents[source, at][1]
            seen.append(at)
        out |= {(source, child, a) for a in seen}
    return out


def found(spark, links):
    df = spark.createDataFrame(links, LINKS)
    return {tuple(r) for r in hierarchy.ancestors(df).select("source", "artifact_id", "ancestor_id").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    links = []
    for source in "ab":
        for k in range(40):
            for _ in range(rng.choice([1, 1, 2])):
                links.append(link(f"n{k}", rng.choice([f"n{rng.randrange(45)}", None, "", "gone"]), rng.randrange(5), source))
    links += links[:10] + [link("n1", "n2", 9, "a", "REF"), link(None, "n3"), (None, "x", "PARENT", 0, None, "y", T0)]
    assert found(spark, links) == brute(links)


def test_long_chain_and_ring(spark, rows):
    links = [link(f"c{k}", f"c{k + 1}") for k in range(70)] + [link("r1", "r2"), link("r2", "r3"), link("r3", "r1"), link("tail", "r1"), link("own", "own")]
    assert found(spark, links) == brute(links)
    artifacts = spark.createDataFrame([("s", "c0"), ("s", "lone"), ("s", "r1"), ("s", None)], "source string, artifact_id string")
    df = hierarchy.hierarchy(artifacts, spark.createDataFrame(links, LINKS))
    by = {r.artifact_id: r for r in df.collect()}
    assert (by["c0"].depth, by["c0"].root, by["c70"].n_descendants, by["c70"].depth) == (70, "c70", 70, 0)
    assert by["c1"].path.startswith("c70 > c69") and by["c1"].path.endswith("> c1")
    assert (by["lone"].depth, by["lone"].root, by["lone"].path, by["lone"].cyclic) == (0, "lone", "lone", False)
    assert by["r1"].cyclic and by["tail"].cyclic and by["own"].cyclic and by["tail"].depth is None
    assert by["own"].path == "own > own"


def test_ties_null_times_and_empty(spark):
    assert found(spark, [link("a", "b", 1), link("a", "c", 1)]) == {("s", "a", "c")}
    assert found(spark, [link("a", "b", None), link("a", "c", 1)]) == {("s", "a", "c")}
    assert found(spark, []) == set()


def test_heavy_keys_keep_every_row(spark, rows):
    left = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(300)] + [(None, 999)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, w int")
    for how in ("left", "inner"):
        plain = rows(left.join(right, "k", how))
        assert rows(skew.unique_lookup(left, right, ["k"], how, parts=10, floor=20)) == plain
    assert skew.heavy_keys(left, ["k"], parts=10, floor=20).count() == 1
