import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import abuse, leakage, markup, neighbours, splitting, tokenizing

any_text = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,;!?。")), max_size=400)


@settings(max_examples=150, deadline=None)
@given(any_text, st.integers(5, 60), st.integers(0, 30))
def test_pieces_fit_cover_and_go_on(text, limit, overlap):
    overlap = min(overlap, limit // 2)
    text = text.strip(splitting.OUTER)
    at = last = 0
    for i, (a, b) in enumerate(splitting.spans_of(text, limit, overlap)):
        assert 0 < b - a <= limit and text[at:a].strip() == "" and (i == 0 or (a > last and at - a <= overlap))
        at, last = max(at, b), a
    assert text[at:].strip() == ""


@pytest.mark.skipif(not os.path.exists(tokenizing.BYTE_BPE_50K), reason="no vocabulary file")
@settings(max_examples=200, deadline=None)
@given(any_text)
def test_ids_are_the_library_s_and_decode(text):
    c = tokenizing.codec()
    ids, starts, ends = c.offsets(text)
    assert ids == (c.whole(text) if text else []) and c.decode(ids, "surrogatepass") == text
    assert (starts <= ends).all() and (len(ids) == 0 or (starts[0] == 0 and ends[-1] == len(text)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pbliae&;#*_`~[](){}|=$\\ \n'x1", max_size=120))
def test_cleaning_never_fails(text):
    out = markup.clean(text)
    assert out is not None and (markup.constructs(text) or out == text)
    assert all(0 <= a < b <= len(text) for _, a, b in markup.subtrees(text))


@settings(max_examples=200, deadline=None)
@given(any_text)
def test_folding_never_fails(text):
    for codes, tokens in abuse.sentences(text):
        assert tokens and 0 <= abuse.votes(codes) < 1 << len(abuse.VOTERS) and all(abuse.meant(tokens))
    assert abuse.fold(text) == abuse.fold(abuse.fold(text)) or not text.isascii()



@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=13, max_size=40), st.integers(0, 20), st.integers(0, 20))
def test_a_shared_run_is_always_found(item, before, after):
    doc = ["zz"] * before + item[: max(13, len(item) - 3)] + ["yy"] * after
    index = leakage.SeedIndex([(1, item)])
    h = np.fromiter((leakage._hashes[w] for w in doc), np.uint64, len(doc))
    best = leakage._best(doc, index.hits(h), index.words, 13)
    assert best[0][0] >= 13


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 4), st.integers(1, 3))
def test_hilbert_keys_are_a_bijection(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = neighbours.hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(1 << (bits * axes)))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()
