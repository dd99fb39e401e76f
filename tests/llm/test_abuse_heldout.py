"""The classifier of abusive content on sentences that are in no table (seen while voters were adjusted)."""

import os

import numpy as np
import pytest
from heldout_abuse import HELD_OUT

from corpusmill.llm import abuse
from corpusmill.runtime import table, written

TABLES = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(TABLES), reason="needs the test tables")
def test_held_out_sentences(spark):
    _, classifier = abuse.fit(written(abuse.vote_table(table(spark, TABLES, "documents"), "text"), "votes"))
    said = [max(classifier.score(tokens, abuse.votes(codes)) for codes, tokens in abuse.sentences(s)) >= abuse.THRESHOLD for _, _, s in HELD_OUT]
    truth = [bool(y) for _, y, _ in HELD_OUT]
    hits = sum(a and b for a, b in zip(said, truth))
    assert hits >= 0.85 * sum(truth) and hits >= 0.85 * sum(said)


def test_sample_is_bounded_and_shared(spark):
    rows = [(k, f"You are a moron number {k} of many. The plain text of line {k} says nothing.") for k in range(300)]
    found = abuse.vote_table(spark.createDataFrame(rows, "doc_id bigint, text string"), "text").cache()
    vectors, counts = zip(*((r["votes"], r["n"]) for r in found.where("n IS NOT NULL").groupBy("votes").sum("n").toDF("votes", "n").collect()))
    vectors, counts = np.array(vectors), np.array(counts)
    assert counts.sum() == 600 and (counts == 300).all()
    for rows in (9, 90, 400, 10_000):
        most = abuse._share(vectors, counts, rows)
        assert np.minimum(counts, np.where(vectors == 0, 8 * most, most)).sum() <= rows


def test_every_sentence_is_read(spark):
    """No trigger decides what is scored: a long text's last words count, without a full stop before them."""
    long = "the index holds every page of the corpus in order " * 2_000
    got = [c for c, _ in abuse.sentences(long + "you are a useless moron")]
    assert len(got) > 300 and abuse.votes(got[-1]) & 1 and not any(abuse.votes(c) & 1 for c in got[:-2])
    assert list(abuse.sentences("")) == list(abuse.sentences(" \n ")) == []


def test_dependent_voters_are_found():
    """Two voters that always speak together count about as one; independent ones count as two."""
    rng = np.random.default_rng(7)
    y = rng.random(200_000) < 0.01
    a, c = y & (rng.random(len(y)) < 0.5), y & (rng.random(len(y)) < 0.5)
    vectors, counts = np.unique(a * 1 + a * 2 + c * 4, return_counts=True)
    model = abuse.LabelModel(vectors, counts)
    assert 1 in (model.parent[0], model.parent[1]) or 0 in (model.parent[0], model.parent[1])
    assert model.correlated[0, 1] > 0.9 and min(model.weights[:2]) < 0.1
