"""Incremental index builds from a stream of deliveries (Structured Streaming, ``foreachBatch``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.indexing import build
from corpusmill.operators.surfaces import Strategy
from corpusmill.sources.corpus import last_wins
from corpusmill.sources.store import CorpusStore


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a Parquet table, be it a folder of files or a single file."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(jpath).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", jpath.getName()).parquet(jpath.getParent().toString())


def latest(deliveries: DataFrame) -> DataFrame:
    """The current row of each artifact within a batch: the greatest ``as_of``."""
    kept = deliveries.where("source IS NOT NULL AND artifact_id IS NOT NULL").select("source", "artifact_id", "text", "as_of").distinct()
    return last_wins(kept, ["source", "artifact_id"], F.col("as_of"))


def incremental_build(spark: SparkSession, deliveries: DataFrame, store: CorpusStore, strategy: Strategy, checkpoint: str, embedder_id: str = "none") -> list:
    """Drains a streaming frame of deliveries ``(source, artifact_id, text, as_of)`` into the store.

    Each micro-batch is a partial scan, so nothing vanishes; a replayed batch finds its artifacts unchanged
    and writes nothing, which makes the at-least-once calls of ``foreachBatch`` exactly-once in effect. The
    stream's offsets live in ``checkpoint``.
    """
    reports = []

    def step(batch: DataFrame, number: int) -> None:
        reports.append((number, build(store, latest(batch), strategy, embedder_id=embedder_id, full=False)))

    query = deliveries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return reports


def windowed_disclosures(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and mean scores per source and tumbling window, closed once ``late`` has passed."""
    rows = events.withWatermark("disclosed_at", late)
    return rows.groupBy(F.window("disclosed_at", every), "source").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
