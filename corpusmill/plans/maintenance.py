"""Queries of index build, change detection, maintenance and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import indexing, policy
from corpusmill.operators.surfaces import Chunked, WholeText
from corpusmill.runtime import scratch_path, table
from corpusmill.sources.corpus import last_wins
from corpusmill.sources.store import CorpusStore
from corpusmill.streaming import incremental

NOW = "2025-01-01 12:00:00"


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "artifacts").where("source IS NOT NULL AND artifact_id IS NOT NULL")
    return rows.select("source", "artifact_id", F.col("raw").alias("text"), F.col("modified_at").alias("as_of"))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.latest(_deliveries(spark, sf_dir))


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as an earlier scan saw it: the oldest content of each artifact, one source missing."""
    rows = _deliveries(spark, sf_dir).distinct().where("source <> 'web'")
    return last_wins(rows, ["source", "artifact_id"], -F.unix_micros(F.col("as_of").cast("timestamp")))


def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current scan, one source gone, against a ledger of the earlier one."""
    strategy = WholeText()
    scan = _current(spark, sf_dir).where("source <> 'tools'").withColumn("version", F.sha2("text", 256))
    earlier = _first(spark, sf_dir).select("source", "artifact_id", F.sha2("text", 256).alias("version"), F.when(F.col("source") == "skills", "other").otherwise("none").alias("embedder_id"), F.lit(strategy.id).alias("strategy_id"), "as_of")
    return indexing.diff(scan, earlier, "none", strategy.id)


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store built from the earlier scan, then brought up to date with the current one."""
    store = CorpusStore(spark, scratch_path(spark, "store"))
    indexing.build(store, _first(spark, sf_dir), WholeText())
    indexing.build(store, _current(spark, sf_dir), WholeText())
    return store.metas().select("source", "artifact_id", "record_id", "surface_index", F.sha2("text", 256).alias("digest"))


def index_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = CorpusStore(spark, scratch_path(spark, "store"))
    indexing.build(store, _current(spark, sf_dir), WholeText())
    return store.read("ledger").select("source", "artifact_id", "version", F.array_join("record_ids", ",").alias("record_ids"))


def stream_incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries through a file stream into a store."""
    schema = table(spark, sf_dir, "artifacts").schema
    stream = incremental.file_stream(spark, f"{sf_dir}/artifacts.parquet", schema).select("source", "artifact_id", F.col("raw").alias("text"), F.col("modified_at").alias("as_of"))
    store = CorpusStore(spark, scratch_path(spark, "store"))
    incremental.incremental_build(spark, stream, store, WholeText(), scratch_path(spark, "stream"))
    return store.metas().select("source", "artifact_id", "record_id", "surface_index", F.sha2("text", 256).alias("digest"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per artifact of a chunked build (places are dense and begin at 0)."""
    rows = indexing.record_rows(_current(spark, sf_dir), Chunked())
    return rows.groupBy("source", "artifact_id").agg(F.count(F.lit(1)).alias("n"), F.max("surface_index").alias("last"), F.count_distinct("record_id").alias("ids"))


def reindex_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its last good run against its policy."""
    runs = table(spark, sf_dir, "runs")
    last = runs.where("status = 'ok'").groupBy("source").agg(F.max("finished_at").alias("last"))
    changed = table(spark, sf_dir, "artifacts").groupBy("source").agg(F.max("delivered_at").alias("delivered"))
    mode, every = F.lit(None).cast("string"), F.lit(None).cast("double")
    for kind in ("packages", "skills", "tools", "reports", "sessions", "web"):
        p = policy.resolve_policy(kind, {"reindex": "manual"} if kind == "web" else None)
        mode, every = F.when(F.col("source") == kind, p["reindex"]).otherwise(mode), F.when(F.col("source") == kind, policy.every_seconds(p)).otherwise(every)
    rows = changed.join(last, "source", "left").select("source", mode.alias("mode"), every.alias("every"), "last", (F.col("delivered") > F.col("last")).alias("changed"))
    return rows.select("source", "mode", policy.reindex_due(F.col("mode"), F.col("every"), F.col("last"), F.col("changed"), F.lit(NOW).cast("timestamp")).alias("due"))


def downtime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that began in a window that passes midnight."""
    return table(spark, sf_dir, "runs").select("run_id", policy.in_downtime(F.hour("started_at"), F.lit(22), F.lit(6)).alias("inside"))


def disclosures_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "disclosures").where("score IS NOT NULL AND NOT isnan(score)")
    out = incremental.windowed_disclosures(rows)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "source", "n", F.round("mean_score", 6).alias("mean_score"))


QUERIES = {
    f.__name__: f
    for f in (change_detection, index_build, index_ledger, stream_incremental_build, chunk_index, reindex_due, downtime_runs, disclosures_per_day)
}

_CURRENT = """cur AS (SELECT source, artifact_id, raw AS text, modified_at FROM artifacts WHERE source IS NOT NULL AND artifact_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY source, artifact_id ORDER BY modified_at DESC NULLS LAST, raw DESC NULLS LAST) = 1)"""
_RECORDS = r"""SELECT source, artifact_id, left(sha256(source || chr(31) || artifact_id || chr(31) || 'document' || chr(31) || '0'), 24) AS record_id, 0 AS surface_index, sha256(text) AS digest
    FROM cur WHERE text IS NOT NULL AND trim(text, E' \t\r\n') <> ''"""

ORACLE_SQL = {
    "change_detection": f"""WITH {_CURRENT}, old AS (SELECT source, artifact_id, raw AS text, modified_at FROM artifacts WHERE source <> 'web' AND artifact_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY source, artifact_id ORDER BY modified_at, raw DESC NULLS LAST) = 1), now AS (SELECT * FROM cur WHERE source <> 'tools')
        SELECT coalesce(n.source, o.source) AS source, coalesce(n.artifact_id, o.artifact_id) AS artifact_id,
               CASE WHEN n.source IS NULL THEN 'vanished' WHEN o.source IS NULL THEN 'new' WHEN sha256(n.text) IS NOT DISTINCT FROM sha256(o.text) AND o.source <> 'skills' THEN 'unchanged' ELSE 'changed' END AS state
        FROM now n FULL JOIN old o ON n.source = o.source AND n.artifact_id = o.artifact_id""",
    "index_build": f"WITH {_CURRENT} {_RECORDS}",
    "stream_incremental_build": f"WITH {_CURRENT} {_RECORDS}",
    "index_ledger": f"""WITH {_CURRENT}, r AS ({_RECORDS}) SELECT c.source, c.artifact_id, sha256(c.text) AS version, coalesce(r.record_id, '') AS record_ids
        FROM cur c LEFT JOIN r ON r.source = c.source AND r.artifact_id = c.artifact_id""",
    "reindex_due": f"""WITH l AS (SELECT source, max(finished_at) AS last FROM runs WHERE status = 'ok' GROUP BY source), c AS (SELECT source, max(delivered_at) AS d FROM artifacts GROUP BY source),
        p AS (SELECT c.*, last, CASE source WHEN 'sessions' THEN 'interval' WHEN 'packages' THEN 'interval' WHEN 'web' THEN 'manual' ELSE 'on-source-change' END AS mode,
                     CASE source WHEN 'sessions' THEN 3600 WHEN 'packages' THEN 604800 ELSE 86400 END AS every FROM c LEFT JOIN l USING (source))
        SELECT source, mode, CASE WHEN mode = 'manual' THEN false WHEN last IS NULL THEN true WHEN mode = 'on-source-change' THEN coalesce(d > last, false)
               ELSE (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last)) / 1e6 >= every END AS due FROM p""",
    "downtime_runs": "SELECT run_id, hour(started_at) >= 22 OR hour(started_at) < 6 AS inside FROM runs",
    "disclosures_per_day": """SELECT date_trunc('day', disclosed_at)::TIMESTAMP AS day, source, count(*) AS n, round(avg(score), 6) AS mean_score FROM disclosures
        WHERE score IS NOT NULL AND NOT isnan(score) AND disclosed_at IS NOT NULL GROUP BY ALL""",
}
