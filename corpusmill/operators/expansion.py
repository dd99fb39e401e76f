"""Context expansion: from a hit to a passage of neighbouring surfaces, stitched without repeating overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import longest_overlap

KEYS = ["source", "artifact_id"]
LEAST_OVERLAP = 8


def siblings(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Every record of each hit's artifact, with the hit's identity beside it."""
    seeds = hits.select("qid", F.col("record_id").alias("seed_id"), *KEYS, F.col("surface_kind").alias("seed_kind"), F.col("surface_index").alias("seed_index"))
    return seeds.join(records.select(*KEYS, "record_id", "surface_kind", "surface_index", "text"), KEYS)


def dangling(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger entries that name records which are not stored: ``source, artifact_id, record_id``."""
    named = ledger.select(*KEYS, F.explode("record_ids").alias("record_id")).distinct()
    return named.join(records.select("record_id").distinct(), "record_id", "left_anti").select(*KEYS, "record_id")


def window_members(hits: DataFrame, records: DataFrame, k: int = 1) -> DataFrame:
    """The hit's record and up to ``k`` records of its kind on either side (neighbours present, not index distance)."""
    order = Window.partitionBy(*KEYS, "surface_kind").orderBy("surface_index", "record_id")
    placed = records.withColumn("__place", F.row_number().over(order))
    seeds = hits.select("qid", F.col("record_id").alias("seed_id")).join(placed.select(F.col("record_id").alias("seed_id"), *KEYS, "surface_kind", F.col("__place").alias("__at")), "seed_id")
    near = seeds.join(placed, [*KEYS, "surface_kind"]).where(F.abs(F.col("__place") - F.col("__at")) <= k)
    return near.select("qid", "seed_id", "record_id", *KEYS, "surface_kind", "surface_index", "text")


def parent_members(hits: DataFrame, records: DataFrame) -> DataFrame:
    """All records of the hit's artifact."""
    return siblings(hits, records).select("qid", "seed_id", "record_id", *KEYS, "surface_kind", "surface_index", "text")


def stitch(members: DataFrame) -> DataFrame:
    """``qid, seed_id, passage, record_ids, n_records``: members in plan order, joined.

    Next to each other (same kind, next index), the longest end of the one that begins the other, of at
    least 8 characters and measured on the record before, is not repeated; else a blank line parts them.
    """
    w = Window.partitionBy("qid", "seed_id").orderBy("surface_index", "record_id")
    placed = members.dropDuplicates(["qid", "seed_id", "record_id"]).select(
        "*", F.row_number().over(w).alias("__n"), F.lag("text").over(w).alias("__text"), F.lag("surface_kind").over(w).alias("__kind"), F.lag("surface_index").over(w).alias("__index")
    )
    adjacent = (F.col("__kind") == F.col("surface_kind")) & (F.col("surface_index") == F.col("__index") + 1)
    shared = F.when(adjacent, longest_overlap(F.col("__text"), F.col("text"), LEAST_OVERLAP)).otherwise(0)
    piece = F.when(F.col("__n") == 1, F.col("text")).when(shared > 0, F.expr("substring(text, __shared + 1)")).otherwise(F.concat(F.lit("\n\n"), F.col("text")))
    pieces = placed.withColumn("__shared", shared).withColumn("__piece", piece.cast("string"))
    rows = pieces.groupBy("qid", "seed_id").agg(F.array_sort(F.collect_list(F.struct("__n", "__piece", "record_id"))).alias("__all"), F.count(F.lit(1)).alias("n_records"))
    return rows.select(
        "qid", "seed_id", F.array_join(F.transform("__all", lambda x: x["__piece"]), "").alias("passage"),
        F.array_join(F.transform("__all", lambda x: x["record_id"]), "|").alias("record_ids"), "n_records",
    )


def expand(hits: DataFrame, records: DataFrame, policy: str = "window", k: int = 1) -> DataFrame:
    """Passages of all hits. A hit whose record is gone comes back with its own text."""
    if policy not in ("window", "parent"):
        raise ValueError(f"unknown policy {policy!r}")
    members = window_members(hits, records, k) if policy == "window" else parent_members(hits, records)
    made = stitch(members)
    own = hits.select("qid", F.col("record_id").alias("seed_id"), F.col("text").alias("__own"))
    joined = own.join(made, ["qid", "seed_id"], "left")
    return joined.select("qid", "seed_id", F.coalesce("passage", "__own").alias("passage"), F.coalesce("record_ids", F.lit("")).alias("record_ids"), F.coalesce("n_records", F.lit(0)).alias("n_records"))


def passage_texts(hits: DataFrame, records: DataFrame, what: str = "surface", max_chars: int = 2000) -> DataFrame:
    """``(qid, record_id, passage)`` for a reranker: the surface's text, or its whole artifact's, cut."""
    if what == "surface":
        return hits.select("qid", "record_id", F.left("text", F.lit(max_chars)).alias("passage"))
    if what != "artifact":
        raise ValueError(f"unknown rerank text {what!r}")
    return stitch(parent_members(hits, records)).select("qid", F.col("seed_id").alias("record_id"), F.left("passage", F.lit(max_chars)).alias("passage"))
