"""Splitting oversized texts at natural boundaries, by ranges.

Method. A text is cut into ranges. Workers detect boundaries (paragraph, line, sentence, clause, word) in
each range, with a halo on both sides so that a boundary at the edge of a range is seen whole and a piece
that begins in the range can end in the halo. Where the next piece begins depends on where the last one
did, so each range tells for *every* place at which a piece can begin first (a number below ``limit``) where
the first piece beyond it begins then, and how many begin in it: few steps, as cuts from different places
soon fall together. These tables of a text are stitched - lengths and piece counts are summed up, the place
is handed from range to range - which is one row a range, whatever the text. The pieces are then emitted by
offset from the range that holds their start.

* :func:`split_texts` takes texts in rows. A row's ranges are worked through where it lies, each handing its
  place to the next; rows of more than ``spread_chars`` have their ranges spread over the cluster.
* :func:`split_files` takes giant files by byte range; no task ever holds more than a range and its halo.

The pieces are the same whatever the size of the ranges.

A piece has at most ``limit`` characters. It ends at the strongest kind of boundary in its second half
(the last one of that kind), else anywhere after the overlap, else at ``limit``. The next piece starts at the first sentence, else the
first word, within the last ``overlap`` characters, else ``overlap`` characters back. White space at the
cuts belongs to no piece, everything else to at least one.

Defined results: outer spaces, tabs, CR and LF are stripped first; null, blank and short texts give no
rows from :func:`split_texts` (they need no splitting); repeated rows of a key and text count once.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 1200, 200
#: Characters (texts) or bytes (files) of a range; characters from which a row's ranges are spread.
RANGE_CHARS, RANGE_BYTES, SPREAD_CHARS = 4_096, 8 << 20, 8 << 20
OUTER = " \t\r\n"
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4, 5
#: One alternative for each kind, strongest first; the boundary lies where the match's white space begins.
_BREAKS = re.compile(
    r"(?P<paragraph>[ \t]*\r?\n[ \t]*(?:\r?\n[ \t]*)+)|(?P<line>[ \t]*\r?\n[ \t]*)"
    r"|(?P<sentence>(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）]*\s*)|(?P<clause>(?<=[;:,])\s+|(?<=[，；：、])\s*)|(?P<word>\s+)"
)
_KIND = {"paragraph": PARAGRAPH, "line": LINE, "sentence": SENTENCE, "clause": CLAUSE, "word": WORD}


def detect(chunk: str, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """Boundaries of ``chunk`` whose end lies in ``(lo, hi]``: ``(end of text, start of next text, kind)``, relative to ``lo``."""
    out = []
    for m in _BREAKS.finditer(chunk):
        a, b = m.span()
        if b > hi:
            break
        if b <= lo:
            continue
        a += len(m.group()) - len(m.group().lstrip("\"'”’»)]」』）"))  # closing quotes stay with their sentence
        out.append((a - lo, b - lo, _KIND[m.lastgroup]))
    return out


class Range:
    """A range of a text in its chunk; places are relative to the range's start and may lie in the right halo."""

    def __init__(self, chunk: str, lo: int, hi: int, ends: bool, limit: int, overlap: int):
        """``ends``: the text ends where the chunk does."""
        self.chunk, self.lo, self.size, self.limit, self.overlap = chunk, lo, hi - lo, limit, min(overlap, limit // 2)
        self.end = len(chunk) - lo if ends else None
        self.bounds = detect(chunk, lo, len(chunk) if ends else min(len(chunk), hi + limit + LEFT_HALO // 2))
        self.ends, self.starts = [b[0] for b in self.bounds], [b[1] for b in self.bounds]

    def _best(self, low: int, high: int, least: int) -> int | None:
        """The last boundary of the strongest kind (``least`` or stronger) that ends in ``(low, high]``."""
        best = None
        for k in range(bisect_right(self.ends, high) - 1, bisect_right(self.ends, low) - 1, -1):
            kind = self.bounds[k][2]
            if kind >= least and (best is None or kind > self.bounds[best][2]):
                best = k
        return best

    def cut(self, s: int) -> tuple[int, int | None]:
        """``(end, next start)`` of the piece that starts at ``s``; no next start at the end of the text."""
        reach = s + self.limit
        if self.end is not None and self.end <= reach:
            return self.end, None
        k = self._best(s + self.limit // 2, reach, SENTENCE)
        for low, least in ((s + self.overlap, SENTENCE), (s + self.limit // 2, WORD), (s + self.overlap, WORD)):
            k = self._best(low, reach, least) if k is None else k
        end = self.ends[k] if k is not None else reach
        back = max(s + 1, end - self.overlap)
        inside = range(bisect_left(self.starts, back), bisect_left(self.starts, end))
        first = next((j for j in inside if self.bounds[j][2] >= SENTENCE), next(iter(inside), None))
        return end, self.starts[first] if first is not None else back if k is None else self.starts[k]

    def spans(self, s: int) -> tuple[list[tuple[int, int]], int | None]:
        """The pieces that start in the range if the first does at ``s``, and where in the next range one starts first (None: the text is over)."""
        out: list[tuple[int, int]] = []
        while s is not None and s < self.size:
            if self.end is not None and s >= self.end:
                return out, None
            end, following = self.cut(s)
            out.append((s, end))
            s = following
        return out, None if s is None or (self.end is not None and s >= self.end) else s - self.size

    def table(self) -> tuple[list[int], list[int]]:
        """For every first start below ``limit``: the first start in the next range (-1: none), and the pieces that start in this one."""
        known: dict[int, tuple[int, int]] = {}
        for first in range(self.limit):
            way, s = [], first
            while s is not None and s < self.size and s not in known and not (self.end is not None and s >= self.end):
                way.append(s)
                s = self.cut(s)[1]
            out, n = (-1, 0) if s is None or (self.end is not None and s >= self.end) else known[s] if s < self.size else (s - self.size, 0)
            if not way:
                known[first] = out, n
            for s in reversed(way):
                n += 1
                known[s] = out, n
        exits, counts = zip(*(known[s] for s in range(self.limit)))
        return list(exits), list(counts)


def ranges_of(text: str, limit: int, overlap: int, size: int):
    """``(start, range)`` of every range of a text that lies in memory."""
    for at in range(0, len(text), size):
        left, hi, right = max(0, at - LEFT_HALO), min(len(text), at + size), min(len(text), at + size + limit + LEFT_HALO)
        yield at, Range(text[left:right], at - left, hi - left, right == len(text), limit, overlap)


def spans_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int | None = None) -> list[tuple[int, int]]:
    """The spans of a text: each range in turn, the place of the next piece handed on (one range unless ``size`` is given)."""
    out, place = [], 0
    for at, r in ranges_of(text, limit, overlap, size or max(1, len(text))):
        found, place = r.spans(place)
        out += [(at + a, at + b) for a, b in found]
        if place is None:
            break
    return out


_PIECE = [T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("piece", T.StringType())]


def split_texts(df: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """``(keys, piece_no, start, end, piece)`` of every text longer than ``limit`` once stripped.

    Offsets count characters of the stripped text.
    """
    if not 0 <= overlap < limit <= range_chars:
        raise ValueError("0 <= overlap < limit <= range_chars must hold")
    body = F.btrim(F.col(text), F.lit(OUTER))
    long = df.select(*keys, body.alias("__body")).where(F.length("__body") > limit).dropDuplicates()
    key_fields = [df.schema[k] for k in keys]

    def near(batches):
        for batch in batches:
            bodies, rows = batch.column(len(keys)).to_pylist(), []
            for r, t in enumerate(bodies):
                rows += [(r, n, a, b, t[a:b]) for n, (a, b) in enumerate(spans_of(t, limit, overlap, range_chars))]
            if rows:
                at, *cols = zip(*rows)
                taken = [batch.column(k).take(pa.array(at)) for k in range(len(keys))]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keys, "piece_no", "start", "end", "piece"])

    rows = long.where(F.length("__body") <= spread_chars).mapInArrow(near, T.StructType([*key_fields, *_PIECE]))
    giant = long.where(F.length("__body") > spread_chars)
    spread = _text_ranges(giant, keys, key_fields, limit, range_chars).repartition(*keys, "__range")
    return rows.unionByName(_by_ranges(spread, keys, key_fields, limit, overlap))


_RANGE = [
    T.StructField("__range", T.LongType()), T.StructField("__lo", T.IntegerType()), T.StructField("__hi", T.IntegerType()),
    T.StructField("__ends", T.BooleanType()), T.StructField("__chunk", T.StringType()),
]
#: Characters before a range that a boundary reaching into it may need.
LEFT_HALO = 64


def _text_ranges(long: DataFrame, keys: list[str], key_fields: list[T.StructField], limit: int, range_chars: int) -> DataFrame:
    """One row per range: its chunk with halos, and where in the chunk the range itself lies."""

    def run(batches):
        names = [*keys, *(f.name for f in _RANGE)]
        for batch in batches:
            for r, t in enumerate(batch.column(len(keys)).to_pylist()):
                for k, (_, x) in enumerate(ranges_of(t, limit, 0, range_chars)):
                    cols = [k], [x.lo], [x.lo + x.size], [x.end is not None], [x.chunk]
                    kinds = pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in range(len(keys))), *(pa.array(c, y) for c, y in zip(cols, kinds))], names)

    return long.mapInArrow(run, T.StructType([*key_fields, *_RANGE]))


def _by_ranges(ranges: DataFrame, keys: list[str], key_fields: list[T.StructField], limit: int, overlap: int) -> DataFrame:
    """Tables of the ranges, stitched by text, then the pieces by offset. Ranges are read twice and never moved for the stitch."""
    ints = T.ArrayType(T.IntegerType())
    table = [T.StructField("__range", T.LongType()), T.StructField("__n", T.IntegerType()), T.StructField("__exits", ints), T.StructField("__counts", ints)]

    def opened(batch):
        lo, hi, ends, chunk = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("__lo", "__hi", "__ends", "__chunk"))
        return [Range(c, a, z, e, limit, overlap) for a, z, e, c in zip(lo, hi, ends, chunk)]

    def tabulate(batches):
        for batch in batches:
            own = opened(batch)
            exits, counts = zip(*(r.table() for r in own)) if own else ((), ())
            kept = [batch.column(batch.schema.get_field_index(n)) for n in (*keys, "__range")]
            cols = [pa.array([r.size for r in own], pa.int32()), pa.array(exits, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept, *cols], [*keys, *(f.name for f in table)])

    entry = [T.StructField("__range", T.LongType()), T.StructField("__base", T.LongType()), T.StructField("__first", T.IntegerType()), T.StructField("__number", T.IntegerType())]

    def stitch(batches):
        """Rows come by text and range number: the sums of lengths and pieces so far, and the place handed on."""
        key, base, place, number = None, 0, 0, 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                own, (k, n, exits, counts) = row[: len(keys)], row[len(keys) :]
                if own != key:
                    key, base, place, number = own, 0, 0, 0
                if place >= 0:
                    out.append((*own, k, base, place, number))
                    number += counts[place]
                    place = exits[place]
                base += n
            if out:
                kinds = [*(batch.column(k).type for k in range(len(keys))), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*keys, *(f.name for f in entry)])

    tables = ranges.mapInArrow(tabulate, T.StructType([*key_fields, *table]))
    entries = tables.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, "__range").mapInArrow(stitch, T.StructType([*key_fields, *entry]))
    left, right = ranges.alias("r"), entries.alias("e")
    same = F.lit(True)
    for k in (*keys, "__range"):
        same = same & F.col(f"r.`{k}`").eqNullSafe(F.col(f"e.`{k}`"))  # null keys meet too
    named = [F.col(f"r.`{k}`").alias(k) for k in (*keys, "__range")]
    joined = left.join(right, same).select(*named, "r.__lo", "r.__hi", "r.__ends", "r.__chunk", "e.__base", "e.__first", "e.__number")

    def emit(batches):
        for batch in batches:
            rows = []
            base, first, number = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("__base", "__first", "__number"))
            for i, r in enumerate(opened(batch)):
                rows += [(i, number[i] + n, base[i] + a, base[i] + b, r.chunk[r.lo + a : r.lo + b]) for n, (a, b) in enumerate(r.spans(first[i])[0])]
            if rows:
                at, *cols = zip(*rows)
                taken = [batch.column(k).take(pa.array(at)) for k in range(len(keys))]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keys, *(f.name for f in _PIECE)])

    return joined.mapInArrow(emit, T.StructType([*key_fields, *_PIECE]))


# --- giant files ---------------------------------------------------------------------------------


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, piece_no, start, end, piece)`` of UTF-8 files on any file system that Arrow knows (a path or a URI).

    A task reads one byte range and a halo. Ranges are cut between characters: a range owns the characters
    that *begin* in it. How many characters that is, is known only after decoding, so the character offsets
    of a range come from the prefix sum over the ranges before it. Invalid bytes become U+FFFD.
    """
    sizes = [(p, _opened(p)[1]) for p in paths]
    rows = [(p, k, at, size) for p, size in sizes for k, at in enumerate(range(0, size, range_bytes))]
    plan = spark.createDataFrame(rows, "path string, __range bigint, at bigint, size bigint") if rows else spark.createDataFrame([], "path string, __range bigint, at bigint, size bigint")
    halo = 4 * (limit + LEFT_HALO)

    def read(batches):
        names = ["path", *(f.name for f in _RANGE)]
        for batch in batches:
            for path, k, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                end = min(size, at + range_bytes)
                first = max(0, at - 4 * LEFT_HALO)
                file, _ = _opened(path)
                with file:
                    raw = file.read_at(min(size, end + halo) - first, first)
                raw_lo, raw_hi = _whole(raw, at - first, at == 0), _whole(raw, end - first, end == size)
                head = raw[_whole(raw, 0, first == 0) : raw_lo].decode("utf-8", "replace")
                own = raw[raw_lo:raw_hi].decode("utf-8", "replace")
                tail = codecs.getincrementaldecoder("utf-8")("replace").decode(raw[raw_hi:], final=end + halo >= size)
                cols = [path], [k], [len(head)], [len(head) + len(own)], [end + halo >= size], [head + own + tail]
                kinds = pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds)], names)

    key = [T.StructField("path", T.StringType())]
    ranges = plan.repartition(max(1, len(rows)), "path", "__range").mapInArrow(read, T.StructType([*key, *_RANGE]))
    return _by_ranges(ranges, ["path"], key, limit, overlap)


def _opened(path: str):
    """A file for random access, and its size."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    file = system.open_input_file(inside)
    return file, file.size()


def _whole(raw: bytes, at: int, edge: bool) -> int:
    """``at``, moved on past the rest of a character that began before it."""
    if not edge:
        for _ in range(3):
            if at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
    return at
