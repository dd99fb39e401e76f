"""Joins against a unique right side that stay even when a few keys hold most left rows.

A key with more than ``rows / parts`` left rows is *heavy*; there can be at most ``parts`` heavy keys, so
the right rows of the heavy keys are a side of proven size and may be broadcast. All other keys have at
most ``rows / parts`` rows each and go through an ordinary shuffle join. No row is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.runtime import cut

#: At most this many keys can be heavy, so at most this many right rows are broadcast.
HEAVY_PARTS = 1000
#: Below this many rows a key is never worth a broadcast of its own.
HEAVY_FLOOR = 20_000


def heavy_keys(left: DataFrame, on: list[str], parts: int = HEAVY_PARTS, floor: int = HEAVY_FLOOR, total: int | None = None) -> DataFrame:
    """Keys of ``left`` with more than ``max(floor, rows / parts)`` rows: at most ``parts`` of them."""
    total = left.count() if total is None else total
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") > max(floor, total // parts)).drop("__n")


def unique_lookup(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", parts: int = HEAVY_PARTS, floor: int = HEAVY_FLOOR, total: int | None = None
) -> DataFrame:
    """``left`` joined to ``right`` (one row per ``on``), with heavy keys answered by a bounded broadcast.

    ``how`` is ``left`` or ``inner``. Null keys match nothing and, for ``left``, keep their row. ``left``
    should be cheap to read twice (a table, a checkpoint): it is counted by key once and then joined.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    heavy = heavy_keys(left, on, parts, floor, total)
    if heavy.isEmpty():
        return left.join(right, on, how)
    heavy = heavy.dropna(subset=on)
    heavy_right = right.join(F.broadcast(heavy), on, "left_semi")
    marked = left.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), on, "left")
    hot = marked.where(F.col("__heavy")).drop("__heavy").join(F.broadcast(heavy_right), on, how)
    cold = marked.where(F.col("__heavy").isNull()).drop("__heavy").join(right, on, how)
    return hot.unionByName(cold)


def running_totals(rows: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """``rows`` (distinct, not null in ``by``) with the running totals ``<sum>_run`` by falling ``by``, and the ``next`` value of ``by``.

    Range-partitioned: totals run within a partition, and what the partitions before it add is one row a partition.
    """
    part = cut(rows.repartitionByRange(F.col(by).desc()).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(F.col(by).desc())
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = part.groupBy("__part").agg(F.max(by).alias("__first"), *(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are partitions
    per = per.select("__part", F.lead("__first").over(Window.orderBy("__part")).alias("__after"), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums))
    ran = part.select("*", F.lead(by).over(inside).alias("__next"), *(F.sum(c).over(so_far).alias(f"__run_{c}") for c in sums))
    joined = ran.join(F.broadcast(per), "__part")
    return joined.select(*rows.columns, *((F.col(f"__run_{c}") + F.col(f"__{c}")).alias(f"{c}_run") for c in sums), F.coalesce("__next", "__after").alias("next"))
