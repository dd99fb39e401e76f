"""Index build: change detection against the ledger, replacement of changed artifacts, pruning of vanished ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import storage_key
from corpusmill.operators.surfaces import Strategy
from corpusmill.runtime import cut
from corpusmill.sources.store import CorpusStore

KEYS = ["source", "artifact_id"]


def diff(artifacts: DataFrame, ledger: DataFrame, embedder_id: str, strategy_id: str, full: bool = True) -> DataFrame:
    """``(source, artifact_id, state)``: new, changed, unchanged, and vanished where the scan is full.

    ``artifacts`` has ``version``. An entry of another embedder or strategy counts as changed. A scan of an
    older ``as_of`` than the ledger's (late delivery) counts as unchanged.
    """
    known = ledger.select(*KEYS, F.col("version").alias("__v"), F.col("embedder_id").alias("__e"), F.col("strategy_id").alias("__s"), F.col("as_of").alias("__at"), F.lit(True).alias("__known"))
    has_time = "as_of" in artifacts.columns
    seen = artifacts.select(*KEYS, "version", F.col("as_of").alias("__new_at") if has_time else F.lit(None).cast("timestamp").alias("__new_at"), F.lit(True).alias("__seen"))
    joined = seen.join(known, KEYS, "full" if full else "left")
    same = F.col("version").eqNullSafe(F.col("__v")) & (F.col("__e") == embedder_id) & (F.col("__s") == strategy_id)
    late = F.coalesce(F.col("__new_at") < F.col("__at"), F.lit(False))
    state = F.when(F.col("__seen").isNull(), "vanished").when(F.col("__known").isNull(), "new").when(same | late, "unchanged").otherwise("changed")
    return joined.select(*KEYS, state.alias("state"))


def record_rows(artifacts: DataFrame, strategy: Strategy, keep: list[str] | None = None) -> DataFrame:
    """Surfaces with their record ids."""
    rows = strategy.decompose(artifacts, [*KEYS, *(keep or [])])
    return rows.withColumn("record_id", storage_key(F.col("source"), F.col("artifact_id"), F.col("surface_kind"), F.col("surface_index")))


@dataclass
class BuildReport:
    new: int
    changed: int
    unchanged: int
    vanished: int
    snapshot: str | None


def build(
    store: CorpusStore, artifacts: DataFrame, strategy: Strategy, *, version: Column | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, embedder_id: str = "none",
    full: bool = True, edges: DataFrame | None = None, metadata: tuple[str, ...] = (),
) -> BuildReport:
    """Brings the store up to date with a scan; a second call with the same scan changes nothing.

    ``embed`` adds a ``vector`` column to surface rows. Edges are replaced for the artifacts that ``edges``
    names. ``full=False``: the scan is a part, so nothing vanishes.
    """
    scan = artifacts.withColumn("version", version if version is not None else F.sha2("text", 256))
    states = cut(diff(scan, store.read("ledger"), embedder_id, strategy.id, full))
    counts = {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    report = BuildReport(*(counts.get(s, 0) for s in ("new", "changed", "unchanged", "vanished")), store.current())
    if report.new + report.changed + report.vanished == 0 and edges is None:
        return report
    todo = states.where("state IN ('new', 'changed')").select(*KEYS)
    gone = states.where("state IN ('changed', 'vanished')").select(*KEYS)
    work = scan.join(todo, KEYS, "left_semi")
    rows = record_rows(work, strategy, list(metadata))
    meta = F.map_filter(F.create_map(*(x for m in metadata for x in (F.lit(m), F.col(m).cast("string")))), lambda k, v: v.isNotNull()) if metadata else F.lit(None).cast("map<string,string>")
    rows = rows.withColumn("metadata", meta)
    rows = embed(rows) if embed else rows.withColumn("vector", F.lit(None).cast("array<float>"))
    fresh = cut(rows.select("source", "record_id", "artifact_id", "surface_kind", "surface_index", "granularity", "text", "vector", "metadata"))
    kept = store.read("records").join(gone, KEYS, "left_anti")
    ids = fresh.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("surface_index", "record_id"))), lambda x: x["record_id"]).alias("record_ids"))
    at = F.col("as_of") if "as_of" in scan.columns else F.lit(None).cast("timestamp")
    entries = work.select(*KEYS, "version", F.lit(embedder_id).alias("embedder_id"), F.lit(strategy.id).alias("strategy_id"), at.alias("as_of")).join(ids, KEYS, "left")
    entries = entries.withColumn("record_ids", F.coalesce("record_ids", F.array().cast("array<string>")))
    stays = store.read("ledger").join(gone, KEYS, "left_anti")
    vanished = states.where("state = 'vanished'").select(*KEYS)
    links = store.read("links").join(vanished, KEYS, "left_anti")
    if edges is not None:
        links = links.join(edges.select(*KEYS).distinct(), KEYS, "left_anti").unionByName(edges.select(*links.columns))
    report.snapshot = store.write({"records": kept.unionByName(fresh), "ledger": stays.unionByName(entries.select(*stays.columns)), "links": links})
    store.put_document("config", {"embedder_id": embedder_id, "strategy": strategy.spec()})
    return report


def open_corpus(store: CorpusStore) -> tuple[DataFrame, dict]:
    """The records and the configuration they were built with (lazy: nothing is read yet)."""
    config = store.get_document("config")
    if config is None:
        raise FileNotFoundError(f"no corpus at {store.root}")
    return store.read("records"), config
