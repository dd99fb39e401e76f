"""Search for agents: one JSON object per query."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.filters import all_of
from corpusmill.operators.search import search

SNIPPET_CHARS = 300


def to_json(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(qid, result)``: ``{"hits": [{rank, score, source, artifact_id, surface_kind, text}]}``; no hits give an empty list."""
    one = F.struct("rank", "score", "source", "artifact_id", "surface_kind", F.left("text", F.lit(SNIPPET_CHARS)).alias("text"))
    per = hits.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("hits"))
    joined = queries.select("qid").join(per, "qid", "left")
    empty = F.array().cast("array<struct<rank:int,score:double,source:string,artifact_id:string,surface_kind:string,text:string>>")
    return joined.select("qid", F.to_json(F.struct(F.coalesce("hits", empty).alias("hits"))).alias("result"))


def make_search(records: DataFrame, *, filter: Mapping | None = None, **defaults) -> Callable[..., DataFrame]:
    """A tool bound to records and a filter that calls can only narrow."""

    def tool(queries: DataFrame, filter_: Mapping | None = None, **overrides) -> DataFrame:
        return to_json(search(records, queries, filter=all_of(filter, filter_), **{**defaults, **overrides}), queries)

    return tool
