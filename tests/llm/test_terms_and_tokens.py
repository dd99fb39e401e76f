import math
import os
import re
from collections import Counter

import pytest

from corpusmill.llm import distinctive, tokenizing

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokenizing.BYTE_BPE_50K), reason="no vocabulary file")


def brute(records):
    tf = {k: Counter(re.findall(r"\w+", (t or "").lower())) for k, t in records.items()}
    df, cf = Counter(), Counter()
    for c in tf.values():
        df.update(c.keys())
        cf.update(c)
    n = len(records)
    return {(k, t): (m, df[t], cf[t], m * (-math.log2(df[t] / n) + math.log2(1 - math.exp(-cf[t] / n)))) for k, c in tf.items() for t, m in c.items()}


def test_against_formula(spark):
    records = {"a": "x x y Foo_1", "b": "x foo_1 ÜBER", "c": None, "d": "", "e": "z " * 5000, "f": " \n", "g": "x"}
    rows = [(k, t, i) for i, (k, t) in enumerate(records.items())] + [("a", records["a"], 0), ("b", "older text", -5), (None, "no key", 1)]
    df = spark.createDataFrame(rows, "record_id string, text string, ingested_at int").withColumnRenamed("ingested_at", "ingested_at")
    got = {(r.record_id, r.term): (r.tf, r.df, r.cf, r.score) for r in distinctive.distinctive_terms(df).collect()}
    want = brute(records)
    assert got.keys() == want.keys()
    for k, (tf, d, c, s) in want.items():
        assert got[k][:3] == (tf, d, c) and got[k][3] == pytest.approx(s, abs=1e-9)


def test_concentrated_beats_spread(spark):
    rows = [(f"r{k}", "common words here " + ("telling telling telling" if k < 2 else "plain"), 0) for k in range(40)]
    got = {r.term: r.score for r in distinctive.distinctive_terms(spark.createDataFrame(rows, "record_id string, text string, ingested_at int")).where("record_id = 'r0'").collect()}
    assert got["telling"] > 4 > 1 > got["common"]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "x y", 1, 9)], "record_id string, text string, term int, df int")
    assert distinctive.distinctive_terms(df, order_by=None).count() == 2
    assert distinctive.distinctive_terms(df.limit(0), order_by=None).count() == 0


TEXTS = ["", "Hello  world\n\n  x", "it's we'll 'tis I'LL", "naïve café 東京 🙂👩‍💻", "<|endoftext|> plain", "a\u00a0b\u200bc\x1cd\x85e", "a" * 5000, "12 345 ٣٤ ½ ²", "tab\tnew\r\nline   end   ", "\ud7ff", "mañana Ωμέγα Жук", "  ", "_" * 300 + " x", "ｆｕｌｌ　wide", "การค้นหา שלום مرحبا"]


@needs_vocabulary
@pytest.mark.parametrize("text", TEXTS)
def test_ids_offsets_and_round_trip(text):
    c = tokenizing.codec()
    want = c.tokenizer.encode(text, add_special_tokens=False)
    ids, starts, ends = c.offsets(text)
    assert ids == want.ids and c.decode(ids, "strict") == text
    if ids:
        assert list(zip(starts.tolist(), ends.tolist())) == want.offsets


@needs_vocabulary
def test_split_characters_decode():
    c = tokenizing.codec()
    ids = c.encode("🙂")
    assert len(ids) > 1 and c.decode(ids[:1]) == "\ufffd" and c.decode(ids[:1], "ignore") == "" and c.decode([], "strict") == ""


@needs_vocabulary
def test_every_row_has_its_ids(spark):
    rows = [(k, t) for k, t in enumerate([*TEXTS, None, None])] + [(0, "")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id bigint, text string, ids string")
    got = tokenizing.encode(df).collect()
    c = tokenizing.codec()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((k, tuple(c.whole(t)) if t else ()) for k, t in rows)
    assert all(r.exact for r in tokenizing.encode_spans(df).collect())
    assert tokenizing.encode(df.limit(0)).count() == 0


def test_byte_table_is_reversible():
    table = tokenizing.byte_table()
    assert sorted(table.values()) == list(range(256)) and table["A"] == 65
