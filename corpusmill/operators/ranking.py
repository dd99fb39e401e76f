"""Rankers over query batches: exact cosine, BM25, their fusion, and what reorders a ranking.

A ranking is a DataFrame ``(qid, <identity columns>, score, rank)``; every step is partitioned by ``qid``,
so evaluation, federation and sweeps cost one job for all queries. Order is total: falling score (rounded
to ``DIGITS``, so that summation order can't decide), then the identity.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import dist_name, tokens

DIGITS = 9
K1, B = 1.5, 0.75
RRF_K, ALPHA, SATURATION = 60, 0.5, 8.0
#: So many (query, term) pairs of a batch are broadcast, some tens of bytes each; more are shuffled.
BROADCAST_TERMS = 500_000


def top(rows: DataFrame, k: int | None, score: str = "score", ties: tuple[str, ...] = ("record_id",), by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The first ``k`` of each query with their ``rank``; Spark limits groups before the shuffle (WindowGroupLimit)."""
    order = [F.col(score).desc(), *(F.col(t) for t in ties)]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


# --- lexical -------------------------------------------------------------------------------------


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """``(qid, term)``: the distinct terms of each query."""
    return queries.select("qid", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def bm25(records: DataFrame, queries: DataFrame, fetch: int | None = None, key: str = "record_id", text: str = "text", k1: float = K1, b: float = B, only: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 of every record that shares a term with a query.

    N, document frequencies and the mean length are those of ``records``: filter first, then rank. Only terms
    that some query has are counted; lengths are taken before that.

    The (query, term) pairs of the batch are counted. Up to ``BROADCAST_TERMS`` they are broadcast, and all
    that is done per record stays where the record is: one exchange by record id, then counting, scoring and
    the first cut to ``fetch`` run without another. With a depth and a matrix of queries by terms of up to
    ``MATRIX_CELLS``, adding up is a matrix product in Arrow batches. Larger batches join by term.

    ``only``: distinct ``record_id`` rows; these records alone are scored, by the statistics of all ``records``.
    """
    asked = query_terms(queries)
    pairs = asked.limit(BROADCAST_TERMS + 1).collect()  # one more than fits tells that the batch is larger
    small = len(pairs) <= BROADCAST_TERMS
    hint = F.broadcast if small else (lambda df: df)
    texts = records.select(F.col(key).alias("record_id"), F.col(text).alias("__x"))
    texts = texts.repartition("record_id") if small else texts  # texts move, not their terms; splitting them is spread evenly
    sized = texts.select("record_id", tokens(F.col("__x")).alias("__t")).withColumn("__dl", F.size("__t"))
    stats = sized.agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"))
    seen = sized.select("record_id", "__dl", F.explode("__t").alias("term")).join(hint(asked.select("term").distinct()), "term", "left_semi")
    postings = seen.groupBy("record_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("__dl").alias("dl"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("__n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = frequency.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "__avg")
    postings = postings if only is None else postings.join(only, "record_id", "left_semi")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("__avg")))
    if fetch is not None and small:
        qids, terms = sorted({r[0] for r in pairs}), sorted({r[1] for r in pairs})
        if len(qids) * len(terms) <= MATRIX_CELLS and len(qids) <= QUERY_BLOCK:
            return _bm25_product(postings, rated, part, pairs, qids, terms, fetch, queries.schema["qid"])
    scores = postings.join(hint(asked.join(rated, "term")), "term").groupBy("qid", "record_id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return top(scores, fetch)


#: Cells of the matrix of queries by terms that a task holds (8 bytes each), and of records by terms at a time.
MATRIX_CELLS, RECORD_CELLS = 8_000_000, 4_000_000


def _bm25_product(postings: DataFrame, rated: DataFrame, part: Column, pairs: list, qids: list, terms: list, fetch: int, qid_field: T.StructField) -> DataFrame:
    at, column = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(terms)}
    q = np.zeros((len(qids), len(terms)))
    for r in pairs:
        q[at[r[0]], column[r[1]]] = 1.0
    numbered = postings.sparkSession.createDataFrame(list(column.items()), "term string, place int").join(rated, "term")
    weights = postings.join(F.broadcast(numbered), "term").groupBy("record_id").agg(F.collect_list("place").alias("p"), F.collect_list(part).alias("w"))

    def score(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        places, values = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
        out, step = np.zeros((len(q), batch.num_rows)), max(1, RECORD_CELLS // max(1, q.shape[1]))
        for low in range(0, batch.num_rows, step):
            mine = (rows >= low) & (rows < low + step)
            m = np.zeros((min(step, batch.num_rows - low), q.shape[1]))
            m[rows[mine] - low, places[mine]] = values[mine]
            out[:, low : low + len(m)] = q @ m.T
        return out

    return top(_stream_top(weights, qids, q, score, fetch, qid_field, postings.schema["record_id"], least=0.0), fetch)


# --- dense ---------------------------------------------------------------------------------------

#: So many queries are held by a task at once; larger batches are cut into blocks by the hash of their id.
QUERY_BLOCK = 4096


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def usable(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return rows.where((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0))


def cosine(records: DataFrame, queries: DataFrame, fetch: int, dim: int, key: str = "record_id", vector: str = "vector", qvector: str = "qvec") -> DataFrame:
    """Exact cosine of every usable record for every usable query, the first ``fetch`` of each.

    A task multiplies its records with a block of queries and keeps ``fetch`` rows a query, so that what is
    shuffled does not grow with the records. Queries are counted and handled in blocks.
    """
    asked = usable(queries, qvector, dim).select("qid", qvector)
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = [asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i) for i in range(blocks)]
    good = usable(records, vector, dim).select(F.col(key).alias("record_id"), vector)
    out = None
    for part in parts:
        scored = _cosine_block(good, part.collect(), fetch, dim, queries.schema["qid"], good.schema["record_id"])
        out = scored if out is None else out.unionByName(scored)
    return top(out, fetch)


def _cosine_block(records: DataFrame, asked: list, fetch: int, dim: int, qid_field: T.StructField, key_field: T.StructField) -> DataFrame:
    q = np.array([r[1] for r in asked], np.float64).reshape(-1, dim)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    return _stream_top(records, [r[0] for r in asked], q, lambda batch, q: q @ _unit(batch.column(1), dim).T, fetch, qid_field, key_field)


def _stream_top(records: DataFrame, qids: list, q: np.ndarray, score, fetch: int, qid_field: T.StructField, key_field: T.StructField, least: float = -np.inf) -> DataFrame:
    """``(qid, record_id, score)``: the ``fetch`` best rows over ``least`` of each query within each partition of ``records``.

    ``score(batch, q)`` gives the scores of a batch, a row per query. The state is ``fetch`` rows a query.
    """
    held = records.sparkSession.sparkContext.broadcast((qids, q))
    schema = T.StructType([qid_field, key_field, T.StructField("score", T.DoubleType())])

    def run(batches):
        qids, q = held.value
        best: list[list[tuple[float, object]]] = [[] for _ in qids]
        floor = np.full(len(qids), np.nextafter(least, np.inf) if np.isfinite(least) else least)
        types = None
        for batch in batches:
            if not batch.num_rows or not qids:
                continue
            types = batch.column(0).type
            ids = batch.column(0).to_pylist()
            s = np.round(score(batch, q), DIGITS)
            if s.shape[1] > fetch:  # nothing under a row's own fetch-th value can be among its first
                floor = np.maximum(floor, -np.partition(-s, fetch - 1, axis=1)[:, fetch - 1])
            rows, cols = np.nonzero(s >= floor[:, None])
            for i, j in zip(rows.tolist(), cols.tolist()):
                best[i].append((-s[i, j], ids[j]))
            for i in np.unique(rows).tolist():
                if len(best[i]) > fetch:
                    best[i] = sorted(best[i])[:fetch]
                    floor[i] = max(floor[i], -best[i][-1][0])
        if types is not None:
            flat = [(qids[i], r, -s) for i, rows in enumerate(best) for s, r in sorted(rows)[:fetch]]
            if flat:
                a, b, c = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(a, arrow_qid), pa.array(b, types), pa.array(c, pa.float64())], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_qid = to_arrow_type(qid_field.dataType)
    return records.mapInArrow(run, schema)


def sparse_cosine(records: DataFrame, queries: DataFrame, fetch: int | None = None) -> DataFrame:
    """Cosine of sparse unit vectors ``(record_id, bucket, weight)`` and ``(qid, bucket, weight)``; pairs without a common bucket have none.

    With a depth and up to ``QUERY_BLOCK`` queries, a task multiplies its records with the queries' matrix and
    keeps ``fetch`` rows a query. Else it is one equi-join by bucket.
    """
    held = queries.select("qid", "bucket", "weight")
    whole = held.groupBy("qid").agg(F.collect_list("bucket").alias("b"), F.collect_list("weight").alias("w"))
    asked = [] if fetch is None else whole.limit(QUERY_BLOCK + 1).collect()
    if fetch is None or len(asked) > QUERY_BLOCK:
        dots = records.join(held.withColumnRenamed("weight", "__w"), "bucket").groupBy("qid", "record_id")
        return top(dots.agg(F.round(F.sum(F.col("weight") * F.col("__w")), DIGITS).alias("score")), fetch)
    dim = 1 + max((max(r["b"]) for r in asked), default=0)
    q = np.zeros((len(asked), dim))
    for i, r in enumerate(asked):
        q[i, r["b"]] = r["w"]

    def score(batch: pa.RecordBatch, q: np.ndarray) -> np.ndarray:
        buckets, weights = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
        asked_for = buckets < q.shape[1]  # no query has a bucket beyond
        m = np.zeros((batch.num_rows, q.shape[1]))
        m[rows[asked_for], buckets[asked_for]] = weights[asked_for]
        return q @ m.T

    packed = records.groupBy("record_id").agg(F.collect_list("bucket").alias("b"), F.collect_list("weight").alias("w"))
    return top(_stream_top(packed, [r["qid"] for r in asked], q, score, fetch, queries.schema["qid"], records.schema["record_id"], least=0.0), fetch)


# --- fusion --------------------------------------------------------------------------------------


def _both(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    d = dense.select("qid", "record_id", F.col("score").alias("ds"), F.col("rank").alias("dr"))
    x = lexical.select("qid", "record_id", F.col("score").alias("ls"), F.col("rank").alias("lr"))
    return d.join(x, ["qid", "record_id"], "full")


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion. A query without lexical hits keeps its dense ranking and cosines."""
    both = _both(dense, lexical)
    some = lexical.select("qid").distinct().withColumn("__lex", F.lit(True))
    mass = F.coalesce(1.0 / (k + F.col("dr")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("lr")), F.lit(0.0))
    scored = both.join(some, "qid", "left").select("qid", "record_id", F.round(F.when(F.col("__lex"), mass).otherwise(F.col("ds")), DIGITS).alias("score"))
    return top(scored, None)


def blend(dense: DataFrame, lexical: DataFrame, alpha: float = ALPHA, saturation: float = SATURATION) -> DataFrame:
    """``alpha * cosine + (1 - alpha) * bm25 / (bm25 + saturation)``; equal scores follow the dense, then the lexical rank.

    A query without hits in one channel keeps the other's ranking and scores as they are.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    ls, ds = F.coalesce("ls", F.lit(0.0)), F.coalesce("ds", F.lit(0.0))
    has = lambda hits, name: hits.select("qid").distinct().withColumn(name, F.lit(True))
    both = _both(dense, lexical).join(has(lexical, "__lex"), "qid", "left").join(has(dense, "__den"), "qid", "left")
    mixed = alpha * ds + (1 - alpha) * F.when(ls > 0, ls / (ls + saturation)).otherwise(0.0)
    scored = both.select(
        "qid", "record_id", F.round(F.when(F.col("__lex").isNull(), ds).when(F.col("__den").isNull(), ls).otherwise(mixed), DIGITS).alias("score"),
        F.coalesce("dr", F.lit(1 << 30)).alias("__dr"), F.coalesce("lr", F.lit(1 << 30)).alias("__lr"),
    )
    return top(scored, None, ties=("__dr", "__lr", "record_id")).drop("__dr", "__lr")


def weigh_surfaces(hits: DataFrame, weights: Mapping[str, float], kind: str = "surface_kind") -> DataFrame:
    """Scores times the weight of their surface kind (1 if it has none), ranked anew."""
    for name, w in weights.items():
        if not np.isfinite(w) or w < 0:
            raise ValueError(f"the weight of {name!r} must be finite and not negative")
    factor = F.lit(1.0)
    for name, w in weights.items():
        factor = F.when(F.col(kind) == name, float(w)).otherwise(factor)
    return top(hits.drop("rank").withColumn("score", F.round(F.col("score") * factor, DIGITS)), None)


def best_per_artifact(hits: DataFrame, keys: tuple[str, ...] = ("source", "artifact_id")) -> DataFrame:
    """The best hit of each artifact, ranked anew; the earlier of equal ones."""
    first = F.row_number().over(Window.partitionBy("qid", *keys).orderBy(F.col("score").desc(), "rank"))
    kept = hits.withColumn("__f", first).where("__f = 1").drop("__f")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank")))


def distinct_surfaces(hits: DataFrame) -> DataFrame:
    return best_per_artifact(hits, ("source", "artifact_id", "surface_kind", "surface_index"))


def demote(score: Column, weight: float) -> Column:
    """A variant's score, lowered by the share ``1 - weight`` of its size (negative scores too)."""
    return score - (1.0 - weight) * F.abs(score)


def merge_variants(hits: DataFrame, weight: float = 1.0) -> DataFrame:
    """Hits of ``(qid, variant)`` queries, variant 0 being the original, merged by their best score."""
    lowered = F.when(F.col("variant") == 0, F.col("score")).otherwise(demote(F.col("score"), weight))
    best = hits.groupBy("qid", "record_id").agg(F.round(F.max(lowered), DIGITS).alias("score"))
    return top(best, None)


def boosted(hits: DataFrame, libraries: Column, deps: Column, weight: float, saturate: int = 1) -> DataFrame:
    """Adds ``weight * min(n, saturate) / saturate`` for n of the wanted libraries among a hit's dependencies, both by their normalised names."""
    if not np.isfinite(weight) or not isinstance(saturate, int) or saturate < 1:
        raise ValueError("weight must be finite and saturate a positive whole number")
    n = F.size(F.array_intersect(F.transform(F.coalesce(deps, F.array().cast("array<string>")), dist_name), F.transform(libraries, dist_name)))
    extra = F.lit(float(weight)) * F.least(n, F.lit(saturate)) / F.lit(float(saturate))
    return top(hits.drop("rank").withColumn("score", F.round(F.col("score") + extra, DIGITS)), None)


# --- rerank --------------------------------------------------------------------------------------


def term_overlap(query: Column, passage: Column) -> Column:
    """The built-in reranker: the share of the query's distinct terms that the passage has."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(passage))) / F.size(asked)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, queries: DataFrame, passages: DataFrame, scorer=term_overlap, fetch: int = 50, max_chars: int = 2000) -> DataFrame:
    """The scorer's value replaces the score of the first ``fetch`` hits; equal passages of a query are scored once.

    ``passages``: ``(record_id, passage)``. ``scorer``: a function of two Columns (query text, passage),
    for models a pandas UDF.
    """
    seen = hits.where(F.col("rank") <= fetch).join(passages.select("record_id", F.left("passage", F.lit(max_chars)).alias("passage")), "record_id")
    pairs = seen.select("qid", "passage").distinct().join(queries.select("qid", F.col("text").alias("__q")), "qid")
    scored = pairs.select("qid", "passage", F.round(scorer(F.col("__q"), F.col("passage")), DIGITS).alias("__s"))
    rows = seen.join(scored, ["qid", "passage"]).withColumn("score", F.col("__s"))
    order = [F.col("score").desc(), F.col("rank")]
    return rows.drop("__s", "passage").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))


# --- fusing rankings of several sources ----------------------------------------------------------


def fuse_hits(hits: DataFrame, rrf_k: int = RRF_K, weights: Mapping[str, float] | None = None, identity: str | None = None, k: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of ``(qid, source, artifact_id, score, pos)`` hits; ``pos`` orders the sources.

    Within a source an identity counts once, at its best place. The representative of an identity is its best
    ranked hit. A query with a single source passes with its own scores.
    """
    key = F.col(identity) if identity else F.concat_ws("\x1f", "source", "artifact_id")
    keyed = hits.withColumn("__key", F.coalesce(key, F.concat_ws("\x1f", "source", "artifact_id")))
    order = Window.partitionBy("qid", "source").orderBy(F.col("score").desc(), "artifact_id")
    placed = keyed.withColumn("__place", F.row_number().over(order))
    once = placed.groupBy("qid", "source", "__key").agg(F.min(F.struct("__place", "pos", "artifact_id", "score")).alias("h"))
    renumbered = once.withColumn("source_rank", F.row_number().over(Window.partitionBy("qid", "source").orderBy("h.__place")))
    factor = F.lit(1.0)
    for name, w in (weights or {}).items():
        factor = F.when(F.col("source") == name, float(w)).otherwise(factor)
    mass = renumbered.withColumn("__mass", factor / (rrf_k + F.col("source_rank")))
    fused = mass.groupBy("qid", "__key").agg(
        F.sum("__mass").alias("mass"), F.min(F.struct("source_rank", F.col("h.pos").alias("pos"), "source", F.col("h.artifact_id").alias("artifact_id"), F.col("h.score").alias("source_score"))).alias("r"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("fused_sources"),
    )
    single = hits.groupBy("qid").agg((F.count_distinct("source") == 1).alias("__single"))
    rows = fused.join(single, "qid").select(
        "qid", "r.source", "r.artifact_id", F.round(F.when(F.col("__single"), F.col("r.source_score")).otherwise(F.col("mass")), DIGITS).alias("score"),
        "r.source_score", "r.source_rank", "fused_sources", F.col("r.pos").alias("pos"),
    )
    return top(rows, k, ties=("source_rank", "pos", "artifact_id")).drop("pos")
