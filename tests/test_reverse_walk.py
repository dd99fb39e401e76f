"""Walks that many queries share, against the rule applied to one query after the other."""

import random

import pytest

from corpusmill.operators import graph

SEEDS = "qid long, source string, artifact_id string, score double"
LINKS = "source string, artifact_id string, edge_type string, pos int, target_source string, target_id string"


def one_by_one(seeds, back, cosines, max_depth, budget, share, near):
    most, want = max(map(len, back.values())), []
    for q in {r[0] for r in seeds}:
        level = {}
        for _, source, name, score in (r for r in seeds if r[0] == q):
            level[source, name] = max(score, level.get((source, name), score))
        seen = level = dict(sorted(level.items(), key=lambda x: (-x[1], x[0]))[:budget])
        for depth in range(1, max_depth + 1):
            fresh = {}
            for node, score in level.items():
                for to in back.get(node, ()):
                    if to not in seen:
                        fresh[to] = max(score, fresh.get(to, score))
            level = dict(sorted(fresh.items(), key=lambda x: (-x[1], x[0]))[: budget - len(seen)])
            seen = seen | level
            want += [(q, *n, depth, round(cosines.get((q, *n), 0.0) + share * len(back.get(n, ())) / most + near / (1.0 + depth), 9)) for n in level]
    return sorted(want, key=repr)


@pytest.mark.parametrize("budget", [5, 9, 1000])
def test_shared_walks_keep_each_querys_rows(spark, rows, monkeypatch, budget):
    for name, value in (("NODE_BLOCK", 3), ("QUERY_BLOCK", 4), ("TASK_PAIRS", 50)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(7)
    names = [f"n{k}" for k in range(30)]
    links = sorted({(rng.choice(names), rng.choice(["n0", "n1", *names])) for _ in range(60)})
    back = {}
    for a, b in links:
        back.setdefault(("s", b), set()).add(("s", a))
    seeds = [(q, "s", "n0", float(q)) for q in range(25)] + [(q, "s", rng.choice(names), rng.choice([1.0, 2.0])) for q in range(25, 60) for _ in range(3)]
    # the same two seeds in both orders and in a tie: three walks, as the budget is spent by order
    seeds += [(q, "s", n, s) for q, a, b in ((60, 2.0, 1.0), (61, 9.0, 3.0), (62, 1.0, 2.0), (63, 1.0, 1.0)) for n, s in (("n0", a), ("n1", b))]
    cosines = {(q, "s", n): round(rng.random(), 3) for q in range(64) for n in rng.sample(names, 4)}
    got = graph.reverse_dependency_walk(
        spark.createDataFrame(seeds, SEEDS), spark.createDataFrame([("s", n) for n in names], "source string, artifact_id string"),
        spark.createDataFrame([("s", a, "REF", 0, None, b) for a, b in links], LINKS), spark.createDataFrame([(*k, v) for k, v in cosines.items()], SEEDS),
        max_depth=2, node_budget=budget, fan_in_weight=0.5, proximity_weight=0.25,
    )
    assert got.columns == ["qid", "source", "artifact_id", "depth", "score"]
    assert rows(got) == one_by_one(seeds, back, cosines, 2, budget, 0.5, 0.25)


def test_a_hub_is_walked_once_for_all_its_queries(spark, monkeypatch):
    """500 queries for a hub with 400 dependents: 200,000 rows come out, 401 are walked."""
    walked = []
    traverse = graph.traverse
    monkeypatch.setattr(graph, "traverse", lambda *a, **k: walked.append(traverse(*a, **k)) or walked[-1])
    seeds = spark.range(500).selectExpr("id AS qid", "'s' AS source", "'hub' AS artifact_id", "rand(1) AS score")
    links = spark.range(400).selectExpr("'s' AS source", "concat('d', id) AS artifact_id", "'REF' AS edge_type", "0 AS pos", "CAST(NULL AS string) AS target_source", "'Hub' AS target_id")
    nodes = links.select("source", "artifact_id").union(spark.createDataFrame([("s", "hub")], "source string, artifact_id string"))
    cosines = spark.createDataFrame([(3, "s", "d7", 0.5), (3, "s", "d8", None), (499, "s", "d7", 0.25), (499, "s", "elsewhere", 1.0)], SEEDS)
    got = graph.reverse_dependency_walk(seeds, nodes, links, cosines, node_budget=1000)
    assert sorted(tuple(r) for r in got.where("score <> 0").collect()) == [(3, "s", "d7", 1, 0.5), (499, "s", "d7", 1, 0.25)]
    assert got.count() == got.select("qid", "artifact_id").distinct().count() == 200_000
    assert [w.count() for w in walked] == [401]
