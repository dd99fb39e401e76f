import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import graph, grep, synonyms

LINKS = "source string, artifact_id string, edge_type string, pos int, target_source string, target_id string"


def test_edges_neighbours_and_resolution(spark, rows):
    made = graph.default_edges(spark.createDataFrame([("s", "app", ["Num_Py>=1", "numpy", "App", "", "x[y]"], "root")], "source string, artifact_id string, deps array<string>, parent string"))
    assert rows(made, "edge_type", "pos", "target_id") == [("PARENT", 0, "root"), ("REF", 0, "num_py"), ("REF", 1, "numpy"), ("REF", 2, "x")]
    links = spark.createDataFrame(
        [("s", "a", "REF", 1, None, "Foo_Bar"), ("s", "a", "REF", 0, "t", "x"), ("s", "a", "REF", 1, None, "Foo_Bar"), ("s", "b", "PARENT", 0, None, "FOO-bar"), ("s", "c", "REF", 0, None, None), ("s", "d", "REF", 0, None, "foo.bar")], LINKS
    )
    nodes = spark.createDataFrame([("s", "foo-bar"), ("s", "a"), ("t", "x")], "source string, artifact_id string")
    assert rows(graph.neighbors(links), "artifact_id", "place", "target_id") == [("a", 1, "x"), ("a", 2, "Foo_Bar"), ("b", 1, "FOO-bar"), ("d", 1, "foo.bar")]
    # a target outside the corpus is a node too, so what depends on it is found; other types and other sources compare exactly
    assert rows(graph.resolve(nodes, links), "artifact_id", "node_id", "inside") == [("a", "foo-bar", True), ("a", "x", True), ("b", "FOO-bar", False), ("d", "foo-bar", True)]
    assert rows(graph.fan_in(nodes, links)) == [("s", "foo-bar", 2), ("t", "x", 1)]
    away = links.unionByName(spark.createDataFrame([("s", "d", "REF", 1, None, "Scikit_Learn"), ("s", "a", "REF", 2, None, "scikit-learn"), ("s", "a", "REF", 3, "t", "X")], LINKS))
    assert rows(graph.fan_in(nodes, away)) == [("s", "foo-bar", 2), ("s", "scikit-learn", 2), ("t", "X", 1), ("t", "x", 1)]


def test_walk_in_a_ring_with_budget(spark, rows):
    edges = spark.createDataFrame([("s", "a", "s", "b"), ("s", "b", "s", "c"), ("s", "c", "s", "a"), ("s", "a", "s", "d")], "source string, artifact_id string, to_source string, to_id string")
    seeds = spark.createDataFrame([(1, "s", "a", 1.0)], "qid int, source string, artifact_id string, score double")
    assert rows(graph.traverse(seeds, edges, 9, 64), "artifact_id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert rows(graph.traverse(seeds, edges, 9, 2), "artifact_id", "depth") == [("a", 0), ("b", 1)]
    assert rows(graph.traverse(seeds, edges, 0, 2), "artifact_id") == [("a",)]


def test_collapsed_tree(spark, rows):
    """Stored leaves make a router, whether they share a word with the query or not; artifacts are seeded once each."""
    hits = spark.createDataFrame([(1, "s", "a", "r1", 0.9), (1, "s", "a", "r0", 0.8), (1, "s", "b", "r2", 0.5), (1, "s", "c", "r3", 0.1)], "qid int, source string, artifact_id string, record_id string, score double")
    stored = spark.createDataFrame([("s", "a", "l1"), ("s", "a", "l2"), ("s", "c", "l3")], "source string, artifact_id string, record_id string")
    scores = spark.createDataFrame([(1, "l2", 0.3)], "qid int, record_id string, score double")
    seeds = graph.tree_seeds(hits, 2)
    assert rows(seeds, "artifact_id", "self_id") == [("a", "r1"), ("b", "r2")]
    assert rows(graph.collapsed_tree(seeds, stored, scores), "record_id", "score", "is_summary") == [("l1", 0.0, False), ("l2", 0.3, False), ("r2", 0.5, True)]
    assert rows(graph.collapsed_tree(seeds, stored, scores, node_budget=3), "record_id") == [("l2",), ("r2",)]


@pytest.mark.parametrize("pattern, fixed, want", [("cat", False, {"a": 2, "b": 1}), ("^cat", False, {"a": 1}), ("a.c", True, {}), ("ca[t]$", False, {"a": 2}), ("C(T", True, {"c": 1})])
def test_grep(spark, pattern, fixed, want):
    df = spark.createDataFrame([("a", "Cat\r\na cat\nno"), ("b", "﻿cats"), ("c", "x c(t"), ("d", None)], "artifact_id string, text string")
    assert {r.artifact_id: r.n_lines for r in grep.grep(df, pattern, fixed=fixed).collect()} == want


def test_grep_weights_and_age(spark):
    df = spark.createDataFrame([("old", "x", datetime(2024, 1, 1)), ("new", "x", datetime(2024, 3, 1))], "artifact_id string, text string, t timestamp")
    got = grep.grep(df, "x", at="t", now=F.lit(datetime(2024, 3, 1)), half_life_days=60, weight=F.lit(2.0)).collect()
    assert [(r.artifact_id, r.score) for r in got] == [("new", 2.0), ("old", 1.0)]
    with pytest.raises(ValueError):
        grep.grep(df, "x", half_life_days=1)


def test_synonyms(spark, rows):
    lines = [json.dumps({"terms": ["k8s", "kubernetes"]}), "not json", json.dumps({"terms": ["one"]}), json.dumps({"terms": ["a", "b"], "status": "demoted"}), json.dumps({"terms": ["log-in", "sign in"], "oneway": True})]
    entries = synonyms.parse_ledger(lines)
    assert [e["terms"][0] for e in entries] == ["k8s", "log-in"]
    ledger = synonyms.ledger(spark, entries)
    asked = spark.createDataFrame([(1, "run K8S log in"), (2, "sign in"), (3, "kubernetes")], "qid int, text string")
    assert rows(synonyms.expand_queries(asked, ledger)) == [
        (1, 0, "run K8S log in"), (1, 1, "run kubernetes log in"), (1, 2, "run K8S sign in"), (2, 0, "sign in"), (3, 0, "kubernetes"), (3, 1, "k8s"),
    ]
    assert len(rows(synonyms.expand_queries(asked, ledger, 2))) == 5
    before, after = (spark.createDataFrame(d, "entry int, ndcg double") for d in ([(0, 0.5), (1, 0.5)], [(0, 0.6), (1, 0.5), (2, 0.1)]))
    assert rows(synonyms.verdicts(before, after), "entry", "verdict") == [(0, "helps"), (1, "no_effect"), (2, "unverifiable")]


def test_one_whole_word_is_swapped(spark, rows):
    ledger = synonyms.ledger(spark, synonyms.parse_ledger([json.dumps({"terms": ["cache", "buffer", "$1 pool\\\\"]}), json.dumps({"terms": ["db", "data base", "data-base"]})]))
    asked = spark.createDataFrame([(1, "cached pages and a cache in the cache"), (2, "a data_base or db")], "qid int, text string")
    assert rows(synonyms.expand_queries(asked, ledger)) == [
        (1, 0, "cached pages and a cache in the cache"), (1, 1, "cached pages and a buffer in the cache"), (1, 2, "cached pages and a $1 pool\\\\ in the cache"),
        (2, 0, "a data_base or db"), (2, 1, "a db or db"),
    ]
    assert synonyms.term_regex("db", "data base") == r"(?i)data[-_ ]?base|\bdb\b"
