"""The stored corpus: records, ledger and links as Parquet snapshots behind an atomically replaced pointer.

A writer writes a whole new snapshot directory and then moves the pointer; readers see one snapshot or the
other, never a mixture. Old snapshots stay until :meth:`CorpusStore.sweep`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.embedding import normalised
from corpusmill.runtime import SharedFiles

RECORDS = (
    "source string, record_id string, artifact_id string, surface_kind string, surface_index int, granularity string, text string, vector array<float>, metadata map<string,string>"
)
LEDGER = "source string, artifact_id string, version string, embedder_id string, strategy_id string, record_ids array<string>, as_of timestamp"
LINKS = "source string, artifact_id string, edge_type string, pos int, target_source string, target_id string"
TABLES = {"records": RECORDS, "ledger": LEDGER, "links": LINKS}


class CorpusStore:
    """One corpus under a root folder (any file system that Hadoop knows)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = SharedFiles(spark, self.root)

    # small documents: configuration, calibration, maintenance state

    def put_document(self, name: str, content: Mapping) -> None:
        if not name or "/" in name or "\\" in name or name.startswith("."):
            raise ValueError(f"no name for a document: {name!r}")
        self.files.replace(f"{name}.json", json.dumps(dict(content), sort_keys=True))

    def get_document(self, name: str) -> dict | None:
        return json.loads(self.files.read(f"{name}.json")) if f"{name}.json" in self.files.names() else None

    # snapshots

    def current(self) -> str | None:
        pointer = self.get_document("current")
        return pointer["snapshot"] if pointer else None

    def read(self, table: str) -> DataFrame:
        snapshot = self.current()
        if snapshot is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/snapshot={snapshot}/{table}")

    def write(self, tables: Mapping[str, DataFrame]) -> str:
        """All tables of the next snapshot (missing ones are carried over), then the pointer."""
        snapshot = uuid.uuid4().hex
        for name, schema in TABLES.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            df = tables.get(name, None)
            df = self.read(name) if df is None else df
            df.select(*columns).write.parquet(f"{self.root}/snapshot={snapshot}/{name}")
        self.put_document("current", {"snapshot": snapshot})
        return snapshot

    def sweep(self) -> list[str]:
        """Deletes snapshots that the pointer does not name."""
        keep, gone = f"snapshot={self.current()}", []
        for name in self.files.names():
            if name.startswith("snapshot=") and name != keep:
                self.files.fs.delete(self.files.path(name), True)
                gone.append(name)
        return gone

    # views

    def matrix(self) -> DataFrame:
        """``(record_id, vector)`` of unit length; zero vectors stay zero."""
        return self.read("records").where("vector IS NOT NULL").select("record_id", normalised(F.col("vector")).alias("vector"))

    def metas(self) -> DataFrame:
        """Records without vectors: the Parquet scan never reads them."""
        return self.read("records").drop("vector")

    def records_for(self, artifacts: DataFrame, surface_kind: str | None = None) -> DataFrame:
        """All records of the given ``(source, artifact_id)``, in plan order through ``surface_index``."""
        rows = self.read("records").join(artifacts.select("source", "artifact_id").distinct(), ["source", "artifact_id"], "left_semi")
        return rows if surface_kind is None else rows.where(F.col("surface_kind") == surface_kind)
