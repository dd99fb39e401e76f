"""The flagship: filter, rank by channels, fuse, weigh, cut, rerank, boost, collapse, first k - for a query batch."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import ranking
from corpusmill.operators.embedding import DIM, hashed
from corpusmill.operators.filters import candidates

IDENTITY = ("source", "artifact_id", "surface_kind", "surface_index")


def fetch_depth(k: int, fetch_k: int | None, widened: bool) -> int:
    """How deep the channels rank: wider where later steps merge or reorder hits."""
    return fetch_k or (max(5 * k, 50) if widened else k)


def search(
    records: DataFrame, queries: DataFrame, *, k: int = 10, mode: str = "hybrid", fusion: str = "rrf", filter: Mapping | None = None, surfaces: Iterable[str] | None = None,
    per_artifact: bool = True, fetch_k: int | None = None, rrf_k: int = ranking.RRF_K, alpha: float = ranking.ALPHA, bm25_sat_k: float = ranking.SATURATION, bm25: Mapping | None = None,
    surface_weights: Mapping[str, float] | None = None, rerank=None, rerank_max_chars: int = 2000, dep_boost: Mapping | None = None, dim: int | None = None, hashed_dim: int = DIM,
) -> DataFrame:
    """``(qid, rank, score, record_id, source, artifact_id, surface_kind, surface_index, text)``.

    ``records``: ``record_id, source, artifact_id, surface_kind, surface_index, text`` and filter fields;
    with ``dim`` the dense channel takes ``vector`` and the queries' ``qvec``, without it hashed terms.
    ``rerank``: a scorer of two Columns. ``dep_boost``: ``{'libs': [...], 'weight': w, 'saturate': n}`` on a
    ``deps`` column. Errors in the arguments raise before any job.
    """
    if mode not in ("dense", "lexical", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    if fusion not in ("rrf", "blend"):
        raise ValueError(f"unknown fusion {fusion!r}")
    if k < 1 or (fetch_k is not None and fetch_k < 1):
        raise ValueError("k and fetch_k must be positive")
    pool = candidates(records, filter, surfaces)
    fetch = fetch_depth(k, fetch_k, per_artifact or rerank is not None or bool(surface_weights) or bool(dep_boost))
    lexical = partial(ranking.bm25, pool, queries, fetch, **(bm25 or {}))

    def dense() -> DataFrame:
        if dim:
            return ranking.cosine(pool, queries, fetch, dim)
        return ranking.sparse_cosine(hashed(pool, "record_id", "text", hashed_dim), hashed(queries, "qid", "text", hashed_dim), fetch)

    if mode == "hybrid":
        d, x = dense(), lexical()
        hits = ranking.rrf(d, x, rrf_k) if fusion == "rrf" else ranking.blend(d, x, alpha, bm25_sat_k)
    else:
        hits = dense() if mode == "dense" else lexical()
    extra = ["deps"] if dep_boost else []
    described = pool.select("record_id", *IDENTITY, "text", *extra)
    if surface_weights:
        hits = ranking.weigh_surfaces(hits.join(described.select("record_id", "surface_kind"), "record_id"), surface_weights).drop("surface_kind")
    hits = hits.where(F.col("rank") <= fetch)
    if rerank is not None:
        hits = ranking.rerank(hits, queries, described.select("record_id", F.col("text").alias("passage")), rerank, fetch, rerank_max_chars)
    hits = hits.join(described, "record_id")
    if dep_boost:
        libs = F.array(*(F.lit(x) for x in dep_boost["libs"]))
        hits = ranking.boosted(hits, libs, F.col("deps"), dep_boost["weight"], dep_boost.get("saturate", 1)).drop("deps")
    if per_artifact:
        hits = ranking.best_per_artifact(hits)
    return hits.where(F.col("rank") <= k).select("qid", "rank", "score", "record_id", *IDENTITY, "text")


def as_retriever(records: DataFrame, **defaults):
    """``search`` with records and settings bound: ``retriever(queries, **overrides)``."""
    return lambda queries, **overrides: search(records, queries, **{**defaults, **overrides})
