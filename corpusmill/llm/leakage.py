"""Evaluation passages inside a training corpus, by spaced-seed hashing.

Method: words of test items and documents are hashed; fixed masks pick some positions of a window and
ignore the others, so a window still hits where words at ignored positions were replaced. Every mask
spans at most ``MIN_RUN`` words, so a passage that shares that many consecutive words hits with every
mask at least once: nothing is lost. A hit names an item and a diagonal (document position minus item
position); the whole diagonal is then compared word by word, as strings, which gives the longest run of
equal words and the longest stretch that is equal but for substitutions.

Plan: the seeds of the test items are counted first. Up to ``SEED_BOUND`` of them are broadcast (about
16 bytes each) and the corpus is scanned once, without a shuffle. Beyond it, seeds of both sides meet in
a shuffle join and the hits are verified beside their texts.

Words are the longest runs of letters and digits, lower-cased; markup tags between words do not count.
Defined results: null, empty and short texts share nothing; repeated rows of a document or item give one
row per document and item; ties do not arise (one row each).
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
MIN_RUN = 13
#: Positions that count, 1, and are ignored, 0. Spans are MIN_RUN at most, so exact runs are never missed; any one
#: replaced word in a window of MIN_RUN leaves some mask unharmed (tested).
MASKS = ("1110110111", "1101001100101", "1011100010111", "111010010111")
SEED_BOUND = 2_000_000
#: A stretch with substitutions ends where mismatches outweigh: +1 a match, -MISS a mismatch.
MISS = 3
#: Shortest stretch with substitutions that is reported where no exact run is long enough.
MIN_MATCHED = 13
_BITS = 20


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORDS.findall((TAG.sub(" ", text) if "<" in text else text).lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_hashes = _Hashes()
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(MIN_RUN)], np.uint64)


def seed_hashes(words: list[str], mask: str) -> np.ndarray:
    """The masked hash at every window position (as unsigned 64 bit)."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter((_hashes[w] for w in words), np.uint64, len(words))
    return _seeds(h, mask)


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    out = np.zeros(n, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += h[k : k + n] * _FACTORS[k]
    return out ^ (out >> np.uint64(29))


class SeedIndex:
    """Seeds of the test items: sorted hashes with item number and position, behind a bitmap of their top bits."""

    def __init__(self, items: list[tuple[object, list[str]]]):
        self.keys = [k for k, _ in items]
        self.words = [w for _, w in items]
        self.masks = []
        for mask in MASKS:
            parts = [(seed_hashes(w, mask), i) for i, w in enumerate(self.words)]
            h = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.uint64)
            item = np.concatenate([np.full(len(p), i) for p, i in parts]) if parts else np.zeros(0, int)
            at = np.concatenate([np.arange(len(p)) for p, _ in parts]) if parts else np.zeros(0, int)
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.masks.append((mask, h[order], item[order], at[order], bitmap))

    def hits(self, h: np.ndarray) -> set[tuple[int, int]]:
        """``(item number, diagonal)`` of every seed hit of a document with word hashes ``h``."""
        out: set[tuple[int, int]] = set()
        for mask, seeds, item, at, bitmap in self.masks:
            if len(h) < len(mask) or not len(seeds):
                continue
            s = _seeds(h, mask)
            pos = np.flatnonzero(bitmap[(s >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(pos):
                continue
            lo, hi = np.searchsorted(seeds, s[pos], "left"), np.searchsorted(seeds, s[pos], "right")
            for p, a, b in zip(pos[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                out.update((int(item[k]), p - int(at[k])) for k in range(a, b))
        return out


def compare(doc: list[str], item: list[str], diagonal: int) -> tuple[int, int, int]:
    """Longest exact run, and matches and length of the best stretch with substitutions, along a diagonal."""
    run = best = score = matched = 0
    start, top, stretch = max(0, -diagonal), 0, (0, 0)
    first = start
    for q in range(start, min(len(item), len(doc) - diagonal)):
        if doc[diagonal + q] == item[q]:
            run, score, matched = run + 1, score + 1, matched + 1
            best = max(best, run)
            if score > top:
                top, stretch = score, (matched, q - first + 1)
        else:
            run, score = 0, score - MISS
            if score <= 0:
                score, matched, first = 0, 0, q + 1
    return best, *stretch


def _best(doc: list[str], found: set[tuple[int, int]], items: list[list[str]], min_run: int) -> dict[int, tuple[int, int, int]]:
    best: dict[int, tuple[int, int, int]] = {}
    for i, diagonal in found:
        run, matched, length = compare(doc, items[i], diagonal)
        if run >= min_run or matched >= MIN_MATCHED:
            old = best.get(i, (0, 0, 0))
            best[i] = (max(run, old[0]), *max((matched, length), old[1:]))
    return best


def _schema(documents: DataFrame, key: str, items: DataFrame, item_key: str) -> T.StructType:
    counts = [T.StructField(n, T.IntegerType(), False) for n in ("exact_run", "matched", "stretch", "item_words")]
    return T.StructType([documents.schema[key], items.schema[item_key], *counts])


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", min_run: int = MIN_RUN, seed_bound: int = SEED_BOUND) -> DataFrame:
    """``(key, item_key, exact_run, matched, stretch, item_words)``: one row per document and item found in it.

    ``exact_run``: longest run of equal consecutive words; ``matched`` of ``stretch`` words equal in the best
    stretch with substitutions. A row has a run of ``min_run`` or more, or ``MIN_MATCHED`` matches or more.
    """
    # an upper bound of the seeds: a word takes a letter and a separator at least
    size = items.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    if (size + 1) // 2 * len(MASKS) > seed_bound:
        return _leaked_by_join(documents, items, key, item_key, text, min_run)
    rows = items.select(item_key, text).dropna().distinct().collect()  # bounded by the check above
    index = SeedIndex([(r[0], words_of(r[1])) for r in rows])
    shared = documents.sparkSession.sparkContext.broadcast(index)
    schema = _schema(documents, key, items, item_key)

    def run(batches):
        index = shared.value
        for batch in batches:
            out = []
            texts = batch.column(1).to_pylist()
            for r, t in enumerate(texts):
                doc = words_of(t)
                if not doc:
                    continue
                found = index.hits(np.fromiter((_hashes[w] for w in doc), np.uint64, len(doc)))
                if found:
                    out += [(r, index.keys[i], *b, len(index.words[i])) for i, b in _best(doc, found, index.words, min_run).items()]
            if out:
                at, ids, *counts = zip(*out)
                cols = [batch.column(0).take(pa.array(at)), pa.array(ids, item_type), *(pa.array(c, pa.int32()) for c in counts)]
                yield pa.RecordBatch.from_arrays(cols, names)

    from pyspark.sql.pandas.types import to_arrow_type

    names, item_type = schema.names, to_arrow_type(schema[item_key].dataType)
    return _one_each(documents.select(key, text).mapInArrow(run, schema), key, item_key)


def _one_each(rows: DataFrame, key: str, item_key: str) -> DataFrame:
    """Repeated deliveries of a document or item: the best row of each pair."""
    best = F.max(F.struct("exact_run", "matched", "stretch", "item_words")).alias("__b")
    return rows.groupBy(key, item_key).agg(best).select(key, item_key, "__b.*")


def _leaked_by_join(documents: DataFrame, items: DataFrame, key: str, item_key: str, text: str, min_run: int) -> DataFrame:
    """For test sets too large to broadcast: seeds meet by shuffle join, hits are verified beside the texts.

    Seeds of documents that no item has drop out in the join; a seed that a third of the documents hold
    is spread by salting the document side and repeating the item's seed for each salt.
    """
    salts = 16

    def seeds(df: DataFrame, name: str):
        schema = T.StructType([T.StructField(name, df.schema[name].dataType), T.StructField("seed", T.LongType()), T.StructField("at", T.IntegerType())])

        def run(batches):
            for batch in batches:
                for r, t in enumerate(batch.column(1).to_pylist()):
                    w = words_of(t)
                    for m, mask in enumerate(MASKS):
                        s = seed_hashes(w, mask) * np.uint64(len(MASKS)) + np.uint64(m)
                        if len(s):
                            ids = batch.column(0).slice(r, 1).take(pa.array(np.zeros(len(s), np.int64)))
                            yield pa.RecordBatch.from_arrays([ids, pa.array(s.view(np.int64)), pa.array(np.arange(len(s), dtype=np.int32))], [name, "seed", "at"])

        return df.select(name, text).mapInArrow(run, schema)

    left = seeds(documents, key).withColumn("salt", F.pmod(F.xxhash64(key, "at"), F.lit(salts)))
    right = seeds(items, item_key).withColumnRenamed("at", "q").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    hits = left.join(right, ["seed", "salt"]).select(key, item_key, (F.col("at") - F.col("q")).alias("diagonal")).distinct()
    beside = hits.join(documents.select(key, F.col(text).alias("__doc")), key).join(items.select(item_key, F.col(text).alias("__item")), item_key)
    schema = _schema(documents, key, items, item_key)

    def verify(batches):
        for batch in batches:
            out = []
            for r, (d, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))):
                doc, item = words_of(a), words_of(b)
                found = _best(doc, {(0, d)}, [item], min_run).get(0)
                if found:
                    out.append((r, *found, len(item)))
            if out:
                at, *counts = zip(*out)
                ids = [batch.column(k).take(pa.array(at)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, pa.int32()) for c in counts)], schema.names)

    return _one_each(beside.select(key, item_key, "diagonal", "__doc", "__item").mapInArrow(verify, schema), key, item_key)
