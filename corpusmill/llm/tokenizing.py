"""Encoding of a corpus with a public byte-level BPE tokenizer, with offsets and exact decoding.

Method: the ``tokenizers`` library over Arrow batches. Byte-level BPE never merges across the pieces of
its split pattern, so the ids of a piece do not depend on the text around it: each worker splits texts by
the pattern and asks the library once per distinct piece (a bounded memo). Texts with characters on whose
class two regular-expression engines might differ go to the library whole. The result is that of the
library either way; tests hold both against it.

Defined results: null and empty text give an empty list; strings that look like special tokens are
ordinary text; repeated rows each give their row; any text length works.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary lies; a parameter of every function. The file is never copied.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published split pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blocks in which both regular-expression engines agree on letter, number and space.
_OUTSIDE = re.compile("[^\t-\r\x20-\x7e\xa1-\xac\xae-ɏΑ-ΡЀ-џ‐-‧‰-⁞₠-₿∀-⋿、-〟ぁ-ゖァ-ヺ一-龥가-힣！-～]")
#: Entries of a worker's memo, and the longest piece it keeps: some tens of MB at most.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48


def byte_table() -> dict[str, int]:
    """The reversible byte alphabet: printable Latin-1 stands for itself, other bytes for U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in printable}
    shifted = (b for b in range(256) if b not in set(printable))
    return table | {chr(0x100 + k): b for k, b in enumerate(shifted)}


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file, made once per worker process."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = regex.compile(SPLIT).findall
        self.memo = _Memo(self.whole)
        table = byte_table()
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = [bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token in map(self.tokenizer.id_to_token, range(size))]
        self.length_of = np.array([len(b) for b in self.bytes_of])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _OUTSIDE.search(text):
            return self.whole(text)
        memo = self.memo
        return [i for piece in self.pieces(text) for i in memo[piece]]

    def offsets(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with their first and one-past-last character. Tokens that share a split character overlap."""
        ids = self.encode(text)
        if not ids:
            return ids, np.zeros(0, np.int32), np.zeros(0, np.int32)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length_of[ids])
        starts = ends - self.length_of[ids]
        return ids, char_of[starts].astype(np.int32), (char_of[ends - 1] + 1).astype(np.int32)

    def decode(self, ids: list[int] | None, errors: str = "replace") -> str:
        """The text of ids; bytes of a character that a cut has split follow ``errors`` (as in ``bytes.decode``)."""
        return b"".join(self.bytes_of[i] for i in ids or []).decode("utf-8", errors)


@lru_cache(maxsize=4)
def codec(path: str = BYTE_BPE_50K) -> Codec:
    return Codec(path)


def _lists(lists: list, kind: pa.DataType) -> pa.ListArray:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


#: Texts of one Arrow batch are encoded in runs of at most so many characters, which bounds the memory.
RUN_CHARS = 2_000_000


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    texts, at, total = batch.column(1).to_pylist(), 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= RUN_CHARS:
            yield batch.column(0).slice(at, k + 1 - at), texts[at : k + 1]
            at, total = k + 1, 0
    if at < len(texts):
        yield batch.column(0).slice(at), texts[at:]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``(key, ids)`` for every row of ``df``. Map-only: no shuffle, whole texts."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for keys, texts in _runs(batch):
                yield pa.RecordBatch.from_arrays([keys, _lists([c.encode(t) for t in texts], pa.int32())], [key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    return df.select(key, text).mapInArrow(run, schema)


def encode_spans(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """``(key, ids, starts, ends, exact)``: ids with character offsets; ``exact`` if decoding gives the text back."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for keys, texts in _runs(batch):
                rows = [c.offsets(t) for t in texts]
                exact = [c.decode(ids, "surrogatepass") == (t or "") for (ids, _, _), t in zip(rows, texts)]
                parts = [_lists([r[k] for r in rows], pa.int32()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([keys, *parts, pa.array(exact)], [key, "ids", "starts", "ends", "exact"])

    ints = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([df.schema[key], *(T.StructField(n, ints, False) for n in ("ids", "starts", "ends")), T.StructField("exact", T.BooleanType(), False)])
    return df.select(key, text).mapInArrow(run, schema)
