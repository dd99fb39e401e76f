"""Parent-child rows to full hierarchies by pointer doubling (paths, depth, root, descendants, rings).

Every node starts with the one-step path to its parent. Each round joins the open pointers with the
table of all pointers and so doubles the distance covered: the path segments are concatenated and the
pointer jumps on. A tree of depth D closes after about log2(D) rounds. A node whose path meets the same
id twice runs into a ring: its distinct path is then all it can reach. ``max_rounds`` follows from the
number of nodes, so the loop ends for any input.

Defined results:

* null or empty ids and targets make no edge; repeated rows count once
* several parents: the row with the greatest ``written_at`` wins, then the greatest target id
* a target that is no artifact is a node (a root) of its own
* on a ring, and on a path into one: ``cyclic`` is true and ``root`` and ``depth`` are null
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.skew import unique_lookup
from corpusmill.runtime import cut

SEGMENT = "ARRAY<STRING>"


def current_parents(links: DataFrame) -> DataFrame:
    """``(source, artifact_id, parent_id)``: the parent each artifact has now.

    ``max`` over a struct is an ordinary partial aggregate, so a hot artifact is combined map-side.
    """
    edges = links.where((F.col("edge_type") == "PARENT") & (F.col("target_id") != "") & (F.col("artifact_id") != "") & F.col("source").isNotNull())
    best = edges.groupBy("source", "artifact_id").agg(F.max(F.struct(F.col("written_at"), F.col("target_id"))).alias("__b"))
    return best.select("source", "artifact_id", F.col("__b.target_id").alias("parent_id"))


def double_pointers(parents: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``(source, artifact_id, path, cyclic)``: ids from the parent upwards, in order, each once.

    ``parents`` has one row per ``(source, artifact_id)``. The frontier of a round holds open nodes only;
    its join key can be as hot as the most popular ancestor, which ``unique_lookup`` splits off.
    """
    state = parents.select(
        "source", "artifact_id", F.array("parent_id").alias("path"), F.col("parent_id").alias("jump"),
        (F.col("artifact_id") == F.col("parent_id")).alias("cyclic"), (F.col("artifact_id") == F.col("parent_id")).alias("closed"),
    )
    state = cut(state)
    nodes = state.count()
    done, unfinished = [state.where("closed")], state.where(~F.col("closed"))
    rounds = max_rounds or int(math.ceil(math.log2(nodes + 2))) + 2
    for _ in range(rounds):
        n_open = unfinished.count()
        if not n_open:
            break
        step = reduce(DataFrame.unionByName, done, unfinished).select(
            "source", F.col("artifact_id").alias("jump"), F.col("path").alias("__next"), F.col("jump").alias("__jump"),
            F.col("cyclic").alias("__cyclic"), F.col("closed").alias("__closed"),
        )
        joined = unique_lookup(unfinished, step, ["source", "jump"], "left", total=n_open)
        longer = F.when(F.col("__next").isNull(), F.col("path")).otherwise(F.concat("path", "__next"))
        grown = joined.select("source", "artifact_id", longer.alias("__path"), "jump", "__jump", "__next", "__cyclic", "__closed")
        grown = grown.withColumn("__distinct", F.array_distinct("__path"))
        repeats = (F.size("__distinct") < F.size("__path")) | F.array_contains("__path", F.col("artifact_id"))
        ring = F.coalesce(F.col("__cyclic"), F.lit(False)) | repeats
        finished = F.col("__next").isNull() | F.coalesce(F.col("__closed"), F.lit(False)) | ring
        moved = grown.select(
            "source", "artifact_id", F.col("__distinct").alias("path"), F.coalesce("__jump", "jump").alias("jump"),
            ring.alias("cyclic"), finished.alias("closed"),
        )
        moved = cut(moved)  # rows that are closed stay where they were written: each is written once
        done, unfinished = [*done, moved.where("closed")], moved.where(~F.col("closed"))
    state = reduce(DataFrame.unionByName, done, unfinished)
    return state.select("source", "artifact_id", "path", (F.col("cyclic") | ~F.col("closed")).alias("cyclic"))


def ancestors(links: DataFrame) -> DataFrame:
    """``(source, artifact_id, ancestor_id, distance, cyclic)``: one row per node and id above it."""
    pointers = double_pointers(current_parents(links))
    return pointers.select("source", "artifact_id", F.posexplode("path").alias("__pos", "ancestor_id"), "cyclic").select(
        "source", "artifact_id", "ancestor_id", (F.col("__pos") + 1).cast("int").alias("distance"), "cyclic"
    )


def hierarchy(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """One row per node: ``source, artifact_id, path, depth, root, n_descendants, cyclic``.

    Nodes are the artifacts, the nodes with a parent and the parents themselves. ``path`` runs from the
    root to the node, joined by ' > '. Descendants are counted by a partial aggregate over the closure and
    listed, one row each, by :func:`ancestors` read the other way; they are never gathered in one array.
    """
    pointers = double_pointers(current_parents(links))
    pointers = cut(pointers)
    up = pointers.select("source", F.explode("path").alias("artifact_id"))
    below = up.groupBy("source", "artifact_id").agg(F.count(F.lit(1)).alias("n_descendants"))
    known = artifacts.select("source", "artifact_id").where(F.col("source").isNotNull() & (F.col("artifact_id") != ""))
    nodes = known.unionByName(pointers.select("source", "artifact_id")).unionByName(below.select("source", "artifact_id")).distinct()
    joined = nodes.join(pointers, ["source", "artifact_id"], "left").join(below, ["source", "artifact_id"], "left")
    cyclic = F.coalesce(F.col("cyclic"), F.lit(False))
    trail = F.coalesce(F.col("path"), F.array().cast(SEGMENT))
    return joined.select(
        "source", "artifact_id",
        F.concat_ws(" > ", F.reverse(trail), F.array("artifact_id")).alias("path"),
        F.when(~cyclic, F.size(trail)).cast("int").alias("depth"),
        F.when(~cyclic, F.when(F.size(trail) > 0, F.element_at(trail, -1)).otherwise(F.col("artifact_id"))).alias("root"),
        F.coalesce("n_descendants", F.lit(0)).cast("bigint").alias("n_descendants"),
        cyclic.alias("cyclic"),
    )
