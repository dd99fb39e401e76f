"""The link graph: edges, neighbours, reverse neighbours, and budgeted walks.

Edges are rows ``(source, artifact_id, edge_type, pos, target_source, target_id)``; a target without a
source lies in the edge's own. REF targets within a source are compared by their normalised name, all others exactly. A node is ``(source, artifact_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import dep_name
from corpusmill.runtime import cut


def normal_id(name: Column) -> Column:
    """How REF targets are compared: lower case, runs of ``-_.`` as one ``-``."""
    return F.regexp_replace(F.lower(F.btrim(name)), r"[-_.]+", "-")


def default_edges(artifacts: DataFrame, deps: str = "deps", parent: str = "parent") -> DataFrame:
    """REF edges from dependencies (bare lower-case names, own name, blanks and repeats dropped), PARENT from the parent."""
    names = F.filter(F.transform(F.coalesce(F.col(deps), F.array().cast("array<string>")), dep_name), lambda d: (d != "") & (d != F.lower(F.col("artifact_id"))))
    refs = artifacts.select("source", "artifact_id", F.lit("REF").alias("edge_type"), F.posexplode(F.array_distinct(names)).alias("pos", "target_id"))
    up = artifacts.where(F.btrim(F.coalesce(F.col(parent), F.lit(""))) != "").select("source", "artifact_id", F.lit("PARENT").alias("edge_type"), F.lit(0).alias("pos"), F.col(parent).alias("target_id"))
    return refs.unionByName(up).withColumn("target_source", F.lit(None).cast("string"))


def clean_links(links: DataFrame) -> DataFrame:
    """Edges with a target, once each at their first position, the target's source filled in and its key added."""
    kept = links.where(F.col("target_id").isNotNull() & (F.btrim("target_id") != "") & F.col("artifact_id").isNotNull())
    full = kept.withColumn("target_source", F.coalesce("target_source", "source"))
    once = full.groupBy("source", "artifact_id", "edge_type", "target_source", "target_id").agg(F.min("pos").alias("pos"))
    return once.withColumn("target_key", F.when((F.col("edge_type") == "REF") & (F.col("target_source") == F.col("source")), normal_id(F.col("target_id"))).otherwise(F.col("target_id")))


def neighbors(links: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Targets of each node in order of first appearance, with their place."""
    rows = clean_links(links)
    rows = rows if edge_type is None else rows.where(F.col("edge_type") == edge_type)
    first = rows.groupBy("source", "artifact_id", "target_source", "target_id").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("source", "artifact_id").orderBy("pos", "target_source", "target_id")
    return first.withColumn("place", F.row_number().over(w)).drop("pos")


def resolve(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Every edge with the node it points to: the exact id, else (REF only) the first node with the same normalised id.

    A target outside the corpus is a node of its own, known by its key (for REF the normalised name), so that
    what depends on it is found too; ``inside`` is false there.
    """
    edges = clean_links(links)
    exact = nodes.select(F.col("source").alias("target_source"), F.col("artifact_id").alias("target_id"), F.col("artifact_id").alias("__exact")).distinct()
    loose = nodes.groupBy(F.col("source").alias("target_source"), normal_id(F.col("artifact_id")).alias("target_key")).agg(F.min("artifact_id").alias("__loose"))
    joined = edges.join(exact, ["target_source", "target_id"], "left").join(loose, ["target_source", "target_key"], "left")
    found = F.coalesce("__exact", F.when((F.col("edge_type") == "REF") & (F.col("target_source") == F.col("source")), F.col("__loose")))
    return joined.withColumn("node_id", F.coalesce(found, "target_key")).withColumn("inside", found.isNotNull()).drop("__exact", "__loose")


def reverse_neighbors(nodes: DataFrame, links: DataFrame, edge_type: str = "REF") -> DataFrame:
    """``(source, artifact_id, from_source, from_id)``: who points to each node, targets outside the corpus included."""
    edges = resolve(nodes, links).where(F.col("edge_type") == edge_type)
    return edges.select(F.col("target_source").alias("source"), F.col("node_id").alias("artifact_id"), F.col("source").alias("from_source"), F.col("artifact_id").alias("from_id")).distinct()


def fan_in(nodes: DataFrame, links: DataFrame, edge_type: str = "REF") -> DataFrame:
    """How many distinct nodes point to each target."""
    return reverse_neighbors(nodes, links, edge_type).groupBy("source", "artifact_id").agg(F.count(F.lit(1)).alias("fan_in"))


# --- walks ---------------------------------------------------------------------------------------


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int = 2, node_budget: int = 64) -> DataFrame:
    """A level-synchronous walk per query: ``(qid, source, artifact_id, depth, score)``.

    ``seeds``: ``(qid, source, artifact_id, score)``. ``edges``: ``(source, artifact_id, to_source, to_id)``
    with an optional ``score`` of the target. A node is visited once, at the first level that reaches it, on
    its best path; a level commits its best nodes until the query's budget is full. The loop runs
    ``max_depth`` times whatever the graph, so rings and endless fresh nodes end.
    """
    if max_depth < 0 or node_budget < 1:
        raise ValueError("max_depth must not be negative and node_budget positive")
    by_score = Window.partitionBy("qid").orderBy(F.col("score").desc(), "source", "artifact_id")
    level = seeds.groupBy("qid", "source", "artifact_id").agg(F.max("score").alias("score")).withColumn("__n", F.row_number().over(by_score))
    level = level.where(F.col("__n") <= node_budget).drop("__n").withColumn("depth", F.lit(0))
    visited = level = cut(level.select("qid", "source", "artifact_id", "depth", "score"))
    has_score = "score" in edges.columns
    for depth in range(1, max_depth + 1):
        step = edges.select("source", "artifact_id", "to_source", "to_id", *([F.col("score").alias("__own")] if has_score else []))
        reached = level.join(step, ["source", "artifact_id"])
        score = F.col("__own") if has_score else F.col("score")
        fresh = reached.groupBy("qid", F.col("to_source").alias("source"), F.col("to_id").alias("artifact_id")).agg(F.max(score).alias("score"))
        fresh = fresh.join(visited.select("qid", "source", "artifact_id"), ["qid", "source", "artifact_id"], "left_anti")
        room = visited.groupBy("qid").agg((F.lit(node_budget) - F.count(F.lit(1))).alias("__room"))
        ranked = fresh.withColumn("__n", F.row_number().over(by_score)).join(room, "qid").where(F.col("__n") <= F.col("__room"))
        level = cut(ranked.select("qid", "source", "artifact_id", F.lit(depth).alias("depth"), "score"))
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


#: So many reached nodes and so many queries of a walk are paired at a time, and about so many pairs are the share of a task.
NODE_BLOCK, QUERY_BLOCK, TASK_PAIRS = 512, 2048, 2_000_000


def shared_walks(seeds: DataFrame, node_budget: int = 64) -> DataFrame:
    """``(qid, walk)``: ``walk`` is the least query whose seeds are the same and stand in the same order by score.

    Scores only order the nodes of a walk on edges without scores, so such queries reach the same nodes at the same depths.
    """
    best = seeds.where("qid IS NOT NULL").groupBy("qid", "source", "artifact_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("qid").orderBy(F.col("score").desc())
    ranked = best.withColumn("__n", F.row_number().over(by_score.orderBy(F.col("score").desc(), "source", "artifact_id"))).withColumn("__place", F.when(F.col("score").isNotNull(), F.dense_rank().over(by_score)))
    start = ranked.where(F.col("__n") <= node_budget).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("__place", "source", "artifact_id"))).alias("__start"))
    return start.select("qid", F.min("qid").over(Window.partitionBy("__start")).alias("walk"))


def reverse_dependency_walk(
    seeds: DataFrame, nodes: DataFrame, links: DataFrame, cosines: DataFrame, edge_type: str = "REF", max_depth: int = 2, node_budget: int = 64,
    fan_in_weight: float = 0.0, proximity_weight: float = 0.0,
) -> DataFrame:
    """From seeds to what depends on them. Score: best cosine + weighted fan-in share + weighted nearness.

    ``cosines``: ``(qid, source, artifact_id, score)``. Returns ``(qid, source, artifact_id, depth, score)``
    of the reached nodes, without the seeds. Queries with the same seeds walk once together. A hub's rows, its
    queries times its dependents, are made where they are put out: blocks of both are shuffled, pairs are not.
    """
    seeds, back = cut(seeds), cut(reverse_neighbors(nodes, links, edge_type))
    degree = back.groupBy("source", "artifact_id").agg(F.count(F.lit(1)).alias("fan_in"))
    most = degree.agg(F.max("fan_in").alias("__most"))
    shares = degree.crossJoin(F.broadcast(most)).select("source", "artifact_id", (F.col("fan_in") / F.col("__most")).alias("__share"))
    block = (F.row_number().over(Window.partitionBy("walk").orderBy("qid")) - 1) / QUERY_BLOCK
    asked = cut(shared_walks(seeds, node_budget).withColumn("__q", F.floor(block).cast("int")))
    step = back.select("source", "artifact_id", F.col("from_source").alias("to_source"), F.col("from_id").alias("to_id"))
    walked = traverse(seeds.join(asked.where("qid = walk").select("qid"), "qid", "left_semi"), step, max_depth, node_budget)
    block = (F.row_number().over(Window.partitionBy("walk").orderBy("source", "artifact_id")) - 1) / NODE_BLOCK
    reached = walked.where("depth > 0").withColumnRenamed("qid", "walk").drop("score").join(shares, ["source", "artifact_id"], "left")
    reached = cut(reached.withColumn("__w", F.floor(block).cast("int")))

    def score(cosine: Column) -> Column:
        return F.round(cosine + fan_in_weight * F.coalesce("__share", F.lit(0.0)) + proximity_weight / (1.0 + F.col("depth")), 9).alias("score")

    key = ["walk", "__w", "__q"]
    with_cosine = cut(cosines.withColumnRenamed("score", "__cos").join(asked, "qid").join(reached, ["walk", "source", "artifact_id"]))
    skipped = with_cosine.groupBy("walk", "__q", "source", "artifact_id").agg(F.collect_set("qid").alias("__skip"))
    queries = asked.groupBy("walk", "__q").agg(F.sort_array(F.collect_list("qid")).alias("__qids"))
    n_queries = asked.groupBy("walk").agg(F.count(F.lit(1)).alias("__queries"), F.max("__q").alias("__last_q"))
    n_nodes = reached.groupBy("walk").agg(F.count(F.lit(1)).alias("__nodes"), F.max("__w").alias("__last_w"))
    pairs = n_queries.join(n_nodes, "walk").agg(F.sum(F.col("__queries") * F.col("__nodes"))).first()[0] or 0
    tasks = max(int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    wide = reached.join(n_queries, "walk").withColumn("__q", F.explode(F.sequence(F.lit(0), "__last_q"))).join(skipped, ["walk", "__q", "source", "artifact_id"], "left")
    wide = wide.select(*key, "source", "artifact_id", "depth", score(F.lit(0.0)), "__skip").repartition(tasks, *key)
    queries = queries.join(n_nodes, "walk").withColumn("__w", F.explode(F.sequence(F.lit(0), "__last_w"))).select(*key, "__qids").repartition(tasks, *key)
    rest = F.when(F.col("__skip").isNull(), F.col("__qids")).otherwise(F.array_except("__qids", "__skip"))
    plain = wide.join(queries, key).select(F.explode(rest).alias("qid"), "source", "artifact_id", "depth", "score")
    return plain.unionByName(with_cosine.select("qid", "source", "artifact_id", "depth", score(F.coalesce("__cos", F.lit(0.0)))))


def tree_seeds(hits: DataFrame, seed_k: int = 10) -> DataFrame:
    """The ``seed_k`` best artifacts of each query by their best summary hit: ``qid, source, artifact_id, self_id, self_score``."""
    best = hits.groupBy("qid", "source", "artifact_id").agg(F.max(F.struct(F.col("score").alias("s"), F.col("record_id").alias("r"))).alias("b"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("b.s").desc(), "source", "artifact_id"))
    return best.withColumn("__n", nth).where(F.col("__n") <= seed_k).select("qid", "source", "artifact_id", F.col("b.r").alias("self_id"), F.col("b.s").alias("self_score"))


def collapsed_tree(seeds: DataFrame, stored: DataFrame, scores: DataFrame, node_budget: int = 64) -> DataFrame:
    """One level: the summaries of ``seeds`` (:func:`tree_seeds`) route to the leaves that their artifacts have stored.

    ``stored``: ``(source, artifact_id, record_id)`` of all leaves, whatever the query; ``scores``: ``(qid,
    record_id, score)`` of leaves, none counting 0. Leaves come out with their own score, the best of a query
    until its budget, seeds included, is spent; an artifact without leaves comes out itself, a router does not.
    """
    leaves = stored.select("source", "artifact_id", "record_id")
    routed = seeds.join(leaves, ["source", "artifact_id"], "left").join(scores.select("qid", "record_id", "score"), ["qid", "record_id"], "left")
    leaf = routed.where("record_id IS NOT NULL").withColumn("score", F.coalesce("score", F.lit(0.0)))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "record_id"))
    room = seeds.groupBy("qid").agg((F.lit(node_budget) - F.count(F.lit(1))).alias("__room"))
    kept = leaf.withColumn("__n", nth).join(room, "qid").where(F.col("__n") <= F.col("__room"))
    own = routed.where("record_id IS NULL").select("qid", "source", "artifact_id", F.col("self_id").alias("record_id"), F.col("self_score").alias("score"), F.lit(True).alias("is_summary"))
    return kept.select("qid", "source", "artifact_id", "record_id", "score", F.lit(False).alias("is_summary")).unionByName(own)
