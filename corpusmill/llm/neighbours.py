"""The most similar vectors of every vector, by shifted space-filling curves.

Method. Each of ``CURVES`` orderings projects the vectors on a few random orthogonal directions (centred
and scaled by the moments of all vectors), shifts the grid and walks it along a Hilbert curve. Spark
range-partitions all rows by (ordering, key); within a partition a window slides along the order and
every row meets its neighbours. The windows of all orderings are merged, and what they propose is
reranked by the exact cosine. A pair is missed only if every curve tears it apart. Without a floor, where far
neighbours count too, the merge goes on: what stands in one row's list of candidates is likely to be near each
other, so the members of each (bounded) list are compared, ``REFINE`` times over.

Plan. Redelivered rows collapse to the latest, exact copies to one representative (so a group of copies
with a third of all rows is one row from there on). The one wide shuffle moves, per ordering, a key, an
id and a code of one byte a component; candidates are exact ids and few. Exact vectors meet the
candidates only for the rerank. Copies get their neighbours back by a look-up that spreads hot classes.

Defined results: usable vectors have ``dim`` components, none null or NaN or infinite, not all zero;
other rows neither search nor are found. Ties in the cosine go to the smaller id. A row is not its own
neighbour. Copies have cosine 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.topn import top_n
from corpusmill.operators.skew import unique_lookup
from corpusmill.runtime import written

CURVES, AXES, BITS = 8, 12, 4
#: Rows of a block of the sorted order, and rows before it that it also meets.
BLOCK, HALO = 256, 64
#: A code's cosine is this near the exact one for all practical vectors; candidates get that much grace.
GRACE = 0.02
#: Proposals kept per row beyond ``k``, for the exact rerank to choose from: by a window with a floor, and by the
#: merge; and by a window without a floor, where every row of every window proposes.
SPARE, SPARE_OPEN = 8, 3
#: Without a floor also far neighbours count, which a curve keeps together less often: more of them, wider windows.
CURVES_OPEN, HALO_OPEN = 16, 2048
#: How often the members of the candidate lists are compared with each other, without a floor.
REFINE = 2
SEED = 20_240_229


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (rows of ``grid``) along the Hilbert curve, by Skilling's transform."""
    x = np.ascontiguousarray(grid.T)
    axes, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(axes):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, 0) ^ t
            x[i] ^= t
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """The orderings: projection, scale and shift of each, from the moments of the vectors."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, curves: int, axes: int, bits: int, seed: int):
        rng, dim = np.random.default_rng(seed), len(mean)
        axes = min(axes, dim)
        self.bits, self.parts = bits, []
        for _ in range(curves):
            r = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :axes]
            spread = np.sqrt(np.maximum(np.einsum("ia,ij,ja->a", r, covariance, r), 1e-12))
            self.parts.append((r.astype(np.float32), (mean @ r).astype(np.float32), spread.astype(np.float32), rng.uniform(0, 1, axes).astype(np.float32)))

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per ordering, the key with the number of the ordering above it."""
        out = []
        for n, (r, mean, spread, shift) in enumerate(self.parts):
            y = (unit @ r - mean) / spread / 6 + 0.5  # three deviations either side
            cells = np.clip((y * 0.75 + shift * 0.25) * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert_keys(cells, self.bits) | (n << (self.bits * cells.shape[1])))
        return out


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Rows with a key and a usable vector."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(key).isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(-1, dim)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # first by the largest component: no overflow, no underflow
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _moments(rows: DataFrame, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the unit vectors: dim * (dim + 1) + 1 sums, added up in Spark."""

    def run(batches):
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            if batch.num_rows:
                u = _matrix(batch.column(0), dim)
                total += np.concatenate([[len(u)], u.sum(0), (u.T @ u).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "x"])

    sums = rows.select(vector).mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(1 + dim + dim * dim)
    for r in sums:
        total[r["at"]] = r["x"]
    n = max(total[0], 1.0)
    mean = total[1 : 1 + dim] / n
    return mean, total[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)


def _coded(rows: DataFrame, curves: Curves, dim: int) -> DataFrame:
    """``(place, id, code)``: one row per vector and ordering."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1), dim)
            scale = np.abs(unit).max(axis=1, keepdims=True)
            codes = np.rint(unit / scale * 127).astype(np.int8)
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            for keys in curves.keys(unit.astype(np.float32)):
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), code], ["place", "id", "code"])

    id_field = T.StructField("id", rows.schema["id"].dataType)
    return rows.select("id", "vector").mapInArrow(run, T.StructType([T.StructField("place", T.LongType()), id_field, T.StructField("code", T.BinaryType())]))


def _by_curve(batches, shift: int):
    """The batches cut where another ordering begins: ``(starts anew, ids, unit codes, id type)``. A window stays within one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        curve = batch.column(0).to_numpy() >> shift
        cuts = [0, *(np.flatnonzero(curve[1:] != curve[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int8).reshape(b - a, -1).astype(np.float32)
            yield curve[a] != last, part.column(1).to_pylist(), codes / np.linalg.norm(codes, axis=1, keepdims=True), batch.column(1).type
            last = curve[a]


def _windows(ordered: DataFrame, dim: int, most: int, floor: float, shift: int) -> DataFrame:
    """``(a, b, approx)`` with a < b: what the windows propose. A partition is streamed; HALO rows are carried on."""
    id_type = ordered.schema["id"].dataType

    def run(batches):
        held = np.zeros((0, dim), np.float32)
        names: list = []
        for anew, ids, fresh, kind in _by_curve(batches, shift):
            if anew:
                held, names = held[:0], []
            every, names = np.concatenate([held, fresh]), names + ids
            old, a, b, c = len(held), [], [], []
            for at in range(old, len(every), BLOCK):
                low, end = max(0, at - HALO), min(at + BLOCK, len(every))
                s = every[at:end] @ every[low:end].T
                s[np.arange(end - at), np.arange(at - low, end - low)] = -2  # itself
                s[:, at - low :][np.tril_indices(end - at)] = -2  # each pair of the block once
                x, y = _best_of(s, most, floor)
                a += (x + at).tolist()
                b += (y + low).tolist()
                c += s[x, y].tolist()
            pairs = [(*((names[i], names[j]) if names[i] < names[j] else (names[j], names[i])), v) for i, j, v in zip(a, b, c) if names[i] != names[j]]
            if pairs:
                left, right, close = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind), pa.array(close, pa.float32())], ["a", "b", "approx"])
            held, names = every[-HALO:], names[-HALO:]

    return ordered.mapInArrow(run, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("approx", T.FloatType())]))


def _windows_open(ordered: DataFrame, dim: int, most: int, halo: int, shift: int) -> DataFrame:
    """``(a, b, approx)`` with a < b: the ``most`` best of each row among ``halo`` rows on either side, in stream order.

    A row's list grows while it is in the halo and is emitted when it leaves: ``most`` rows a row, whatever the halo.
    """
    id_type = ordered.schema["id"].dataType

    def best(s: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = min(most, s.shape[1])
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return np.take_along_axis(s, at, 1), names[at]

    def run(batches):
        kind, held, names = None, np.zeros((0, dim), np.float32), np.zeros(0, object)
        values, others = np.zeros((0, most), np.float32), np.zeros((0, most), object)

        def out(n: int):
            rows = [(min(a, b), max(a, b), v) for a, bs, vs in zip(names[:n], others[:n], values[:n]) for b, v in zip(bs, vs) if v > -2 and a != b]
            a, b, v = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(v, pa.float32())], ["a", "b", "approx"])

        for anew, listed, fresh, kind in _by_curve(batches, shift):
            ids = np.array(listed, object)
            if anew and len(held):
                yield out(len(held))
                held, names, values, others = held[:0], names[:0], values[:0], others[:0]
            for at in range(0, len(fresh), BLOCK):
                block, own, h = fresh[at : at + BLOCK], ids[at : at + BLOCK], len(held)
                every, known = np.concatenate([held, block]), np.concatenate([names, own])
                s = block @ every.T
                s[np.arange(len(block)), h + np.arange(len(block))] = -2  # itself
                new_values, new_others = np.full((len(block), most), -2, np.float32), np.full((len(block), most), None, object)
                v, o = best(s, known)
                new_values[:, : v.shape[1]], new_others[:, : v.shape[1]] = v, o
                if h:
                    v, o = best(s[:, :h].T, own)
                    both_v, both_o = np.concatenate([values, v], 1), np.concatenate([others, o], 1)
                    pick = np.argpartition(-both_v, most - 1, axis=1)[:, :most]
                    values, others = np.take_along_axis(both_v, pick, 1), np.take_along_axis(both_o, pick, 1)
                held, names, values, others = every, known, np.concatenate([values, new_values]), np.concatenate([others, new_others])
                leave = len(held) - halo
                if leave > 0:
                    yield out(leave)
                    held, names, values, others = held[leave:], names[leave:], values[leave:], others[leave:]
        if len(held):
            yield out(len(held))

    return ordered.mapInArrow(run, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("approx", T.FloatType())]))


def _codes_of(rows: DataFrame, dim: int) -> DataFrame:
    """``(id, code)``: one byte a component."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column(1), dim)
                codes = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return rows.select("id", "vector").mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("code", T.BinaryType())]))


def _refined(lists: DataFrame, codes: DataFrame, most: int, dim: int) -> DataFrame:
    """``(a, b, approx)`` with a < b: pairs that stand in one list of ``lists`` (``most`` rows a row at most) and belong into a member's list.

    A member comes with the last value in its own list, so that only pairs that better it leave the task.
    """
    id_type = lists.schema["a"].dataType
    own = lists.groupBy(F.col("a").alias("id")).agg(F.min("approx").alias("least"), F.count(F.lit(1)).alias("n"))
    known = codes.join(own, "id").select(F.col("id").alias("b"), "code", F.when(F.col("n") >= most, F.col("least")).otherwise(F.lit(-2.0).cast("float")).alias("least"))
    members = lists.select("a", "b").join(known, "b").groupBy("a").agg(F.collect_list(F.struct("b", "code", "least")).alias("m"))

    def run(batches):
        for batch in batches:
            m = batch.column(1)
            flat, ends = m.flatten(), m.offsets.to_numpy() - m.offsets[0].as_py()
            if not len(flat):
                continue
            ids, least = flat.field(0), flat.field(2).to_numpy(zero_copy_only=False)
            c = np.frombuffer(b"".join(flat.field(1).to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
            c /= np.linalg.norm(c, axis=1, keepdims=True)
            x, y, v = [], [], []
            for lo, hi in zip(ends, ends[1:]):
                s = c[lo:hi] @ c[lo:hi].T
                i, j = np.nonzero(np.triu(s > np.minimum.outer(least[lo:hi], least[lo:hi]), 1))
                x.append(i + lo)
                y.append(j + lo)
                v.append(s[i, j])
            left, right = ids.take(pa.array(np.concatenate(x))), ids.take(pa.array(np.concatenate(y)))
            yield pa.RecordBatch.from_arrays([left, right, pa.array(np.concatenate(v).astype(np.float32))], ["a", "b", "approx"])

    found = members.mapInArrow(run, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("approx", T.FloatType())]))
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "approx")


def _best_of(s: np.ndarray, most: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Entries of at least ``floor`` that are among the ``most`` greatest of their row or of their column."""
    x, y = np.nonzero(s >= floor)
    if not len(x):
        return x, y
    rows, cols = np.bincount(x, minlength=s.shape[0]), np.bincount(y, minlength=s.shape[1])
    if rows.max() <= most or cols.max() <= most:
        return x, y
    row_cut = np.partition(s, -most, axis=1)[:, -most] if s.shape[1] > most else np.full(s.shape[0], -2.0)
    col_cut = np.partition(s, -most, axis=0)[-most] if s.shape[0] > most else np.full(s.shape[1], -2.0)
    keep = (s[x, y] >= row_cut[x]) | (s[x, y] >= col_cut[y])
    return x[keep], y[keep]


def _cosines(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``(a, b, cosine)`` with the exact cosine of the stored vectors."""
    a = vectors.select(F.col("id").alias("a"), F.col("vector").alias("va"))
    b = vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = np.einsum("ij,ij->i", _matrix(batch.column(2), dim), _matrix(batch.column(3), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c)], ["a", "b", "cosine"])

    return both.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("cosine", T.DoubleType(), False)]))


def nearest(
    df: DataFrame, k: int = 5, dim: int = 64, key: str = "record_id", vector: str = "vector", order_by: str | None = "ingested_at",
    min_cosine: float | None = None, curves: int | None = None, axes: int = AXES, bits: int = BITS, seed: int = SEED,
    refine: int = REFINE,
) -> DataFrame:
    """``(key, rank, neighbour, cosine)``: the ``k`` most similar other rows of each row.

    With ``min_cosine`` only neighbours at least that similar come out; those are then the same as without
    it, since more similar rows rank before. All rows are indexed and all search.
    """
    curves = curves or (CURVES_OPEN if min_cosine is None else CURVES)
    axes = min(axes, dim)
    if curves.bit_length() + axes * bits > 62:
        raise ValueError("the key of an ordering must fit in 62 bits")
    good = usable(df, key, vector, dim)
    # the latest delivery; the struct keeps rows whose time is null, and decides equal times by the vector
    order = F.col(order_by) if order_by else F.lit(0)
    last = good.groupBy(F.col(key).alias("id")).agg(F.max(F.struct(order.alias("o"), F.col(vector).alias("v"))).alias("last"))
    unique = last.select("id", F.col("last.v").alias("vector"))
    # copies: classes of equal vectors, by 128 bits of hash; the class is known by its smallest id
    hashed = unique.select("id", F.md5(F.to_json("vector")).alias("h"))
    classes = hashed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    single = unique.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    mean, covariance = _moments(good, vector, dim)
    # one sort by place gives every partition a stretch of one or two curves
    ordered = _coded(single, Curves(mean, covariance, curves, axes, bits, seed), dim).repartitionByRange("place").sortWithinPartitions("place")
    if min_cosine is None:
        proposed = _windows_open(ordered, dim, k + SPARE_OPEN, HALO_OPEN, axes * bits).groupBy("a", "b").agg(F.max("approx").alias("approx"))
        codes = _codes_of(single, dim)
        short = _lists(proposed, k + SPARE)  # the merge, by the codes' cosine, before vectors move
        for _ in range(refine):
            more = _refined(short, codes, k + SPARE, dim).unionByName(short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "approx"))
            short = _lists(more.groupBy("a", "b").agg(F.max("approx").alias("approx")), k + SPARE)
        pairs = short.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    else:
        pairs = _windows(ordered, dim, k + SPARE, min_cosine - GRACE, axes * bits).select("a", "b").distinct()
    scored = _cosines(pairs, single, dim)
    if min_cosine is not None:
        scored = scored.where(F.col("cosine") >= min_cosine)
    directed = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    return _with_copies(top_n(directed, ["a"], "cosine", "b", k), hashed, classes, key, k)


def _lists(pairs: DataFrame, most: int) -> DataFrame:
    """``(a, b, approx)``, both ways: the ``most`` best of each row, written once."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "approx"))
    return written(top_n(both, ["a"], "approx", "b", most).select("a", "b", "approx"), "lists")


def _with_copies(ranked: DataFrame, hashed: DataFrame, classes: DataFrame, key: str, k: int) -> DataFrame:
    """From representatives to all rows. A class keeps the first k + 1 rows of its list: without the asking
    row itself, the first k of them are that row's neighbours. The lists are bounded, the classes are not
    expanded against each other."""
    crowded = classes.where("copies > 1")
    members = top_n(hashed.join(crowded.select("h", "rep"), "h").select("rep", "id", F.lit(1.0).alias("one")), ["rep"], "one", "id", k + 1)
    members = members.select("rep", "id")
    own = members.withColumn("cosine", F.lit(1.0))
    # a neighbour class without copies is its representative
    near = ranked.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cosine")
    spread = near.join(members.select(F.col("rep").alias("other"), F.col("id").alias("member")), "other", "left")
    near = spread.select("rep", F.coalesce("member", "other").alias("id"), "cosine")
    firsts = top_n(own.unionByName(near), ["rep"], "cosine", "id", k + 1)
    lists = firsts.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("neighbour"), "cosine"))).alias("list"))
    asking = hashed.join(crowded.select("h", "rep"), "h", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    found = unique_lookup(asking, lists, ["rep"], "inner")
    others = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    rows = found.select(F.col("id").alias(key), F.posexplode(others).alias("__p", "__n"))
    return rows.select(key, (F.col("__p") + 1).cast("int").alias("rank"), "__n.neighbour", "__n.cosine")
