"""Processing only new or changed records, by log-based change capture.

The deliveries of ``artifacts`` are a log. Its partitions are the sources; the offset of a row is its
``delivered_at`` in microseconds. A run

1. plans: reads the last committed offset of every partition, takes the present end of the log and
   writes both to the write-ahead log *before* any work (``plan-<n>.json``),
2. works on exactly that offset range, folded to the current row of each key,
3. commits (``commit-<n>.json``).

After a failure the planned batch without a commit is replayed with the *same* offsets, so nothing is
skipped and nothing new slips in. The sink writes under the batch number, overwriting a half-written
try, and its reader keeps the latest row of each key and offset, so nothing counts twice. The sink so holds
the folded state of the log, and a run reads no delivery before its last committed offsets again.

What needs processing is decided against the ledger: the row of the latest *ok* run is the only valid
one; failed, crashed and running runs leave no trace.

Defined results: null ``raw`` is never pending, empty ``raw`` is; a null ``modified_at`` is older than any
other; sources missing in ``corpora`` are compared by version only; repeated rows count once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import SharedFiles

KEY = ["source", "artifact_id"]
#: So many partitions' offsets are broadcast to the log.
PARTITIONS = 100_000


# --- state ---------------------------------------------------------------------------------------


def current_rows(artifacts: DataFrame) -> DataFrame:
    """``(source, artifact_id, version, modified_at, offset)``: the current content of each artifact.

    ``raw`` is hashed before the shuffle, which so moves 64 characters a row instead of whole texts. One
    partial aggregate, no window: a hot artifact is folded map-side. ``version`` is null for a null ``raw``.
    """
    offset = F.unix_micros(F.col("delivered_at").cast("timestamp"))
    keyed = artifacts.where(F.col("source").isNotNull() & F.col("artifact_id").isNotNull())
    hashed = keyed.select(*KEY, "modified_at", F.sha2(F.col("raw"), 256).alias("version"), offset.alias("offset"))
    folded = hashed.groupBy(*KEY).agg(F.max(F.struct("modified_at", "version")).alias("__b"), F.max("offset").alias("offset"))
    return folded.select(*KEY, F.col("__b.version").alias("version"), F.col("__b.modified_at").alias("modified_at"), "offset")


def valid_ledger(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger row of the latest run with status ok, one per artifact."""
    ok = runs.where(F.col("status") == "ok").select(F.col("run_id").alias("__run"), F.col("source").alias("__source")).distinct()
    good = ledger.join(ok, (F.col("run_id") == F.col("__run")) & F.col("source").eqNullSafe(F.col("__source")), "left_semi")
    last = good.groupBy(*KEY).agg(F.max(F.struct("run_id", "written_at", "version", "embedder_id", "strategy_id")).alias("__b"))
    return last.select(*KEY, "__b.version", "__b.embedder_id", "__b.strategy_id", "__b.run_id")


def pending(current: DataFrame, ledger: DataFrame, runs: DataFrame, corpora: DataFrame) -> DataFrame:
    """Artifacts of ``current`` that the next run must process, with the reason (new, content, embedder, strategy)."""
    now = current.where(F.col("version").isNotNull()).select(*KEY, F.col("version").alias("current_version"), "offset")
    done = valid_ledger(ledger, runs).withColumn("__done", F.lit(True))
    use = corpora.groupBy("source").agg(F.max(F.struct("embedder_id", "strategy_id")).alias("__use"))
    use = use.select("source", F.col("__use.embedder_id").alias("use_embedder"), F.col("__use.strategy_id").alias("use_strategy"), F.lit(True).alias("__used"))
    joined = now.join(done, KEY, "left").join(use, "source", "left")  # corpora: one row a source, Spark broadcasts it by its size
    other = F.col("__used").isNotNull()
    reason = (
        F.when(F.col("__done").isNull(), "new")
        .when(~F.col("version").eqNullSafe(F.col("current_version")), "content")
        .when(other & ~F.col("embedder_id").eqNullSafe(F.col("use_embedder")), "embedder")
        .when(other & ~F.col("strategy_id").eqNullSafe(F.col("use_strategy")), "strategy")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*KEY, "current_version", "offset", "reason")


# --- write-ahead log -----------------------------------------------------------------------------


@dataclass
class Batch:
    """A planned range of the log: per partition, offsets above ``start`` up to and including ``end``."""

    number: int
    start: dict[str, int]
    end: dict[str, int]
    committed: bool = False
    replayed: bool = field(default=False, compare=False)

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "start": self.start, "end": self.end}, sort_keys=True)


class ChangeCapture:
    """Plans, replays and commits batches over the log of one table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, SharedFiles(spark, root + "/wal")

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n[len(kind) + 1 : -5]) for n in self.files.names() if n.startswith(kind + "-") and n.endswith(".json"))

    def _load(self, number: int) -> Batch:
        x = json.loads(self.files.read(f"plan-{number}.json"))
        return Batch(x["number"], x["start"], x["end"])

    def committed_offsets(self) -> dict[str, int]:
        done = self._numbers("commit")
        return self._load(done[-1]).end if done else {}

    def plan(self, log: DataFrame, until: dict[str, int] | None = None) -> Batch:
        """The batch to work on now: the planned one without a commit, else a new one up to the log's end.

        The log's end is one number per partition (a partial aggregate; sources are few by definition).
        ``until`` ends the new batch at these offsets where the log goes on; partitions it lacks wait.
        """
        plans, done = self._numbers("plan"), self._numbers("commit")
        if plans and plans[-1] not in done:
            batch = self._load(plans[-1])
            batch.replayed = True
            return batch
        start = self.committed_offsets()
        ends = log.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.unix_micros(F.col("delivered_at").cast("timestamp"))).alias("e"))
        end = {r["source"]: r["e"] for r in ends.collect() if r["e"] is not None}
        if until is not None:
            end = {s: min(e, until[s]) for s, e in end.items() if s in until}
        end = start | {s: max(e, start.get(s, e)) for s, e in end.items()}
        batch = Batch((plans[-1] + 1) if plans else 0, start, end)
        self.files.publish(f"plan-{batch.number}.json", batch.to_json())
        return batch

    def commit(self, batch: Batch) -> None:
        if batch.number not in self._numbers("commit"):
            self.files.publish(f"commit-{batch.number}.json", batch.to_json())
        batch.committed = True

    def upto(self, log: DataFrame, batch: Batch) -> DataFrame:
        """Rows of the log up to the end of the batch: later deliveries belong to the next run."""
        return self._range(log, batch, "end", upper=True)

    def changes(self, log: DataFrame, batch: Batch) -> DataFrame:
        """Rows of the log within the batch."""
        rows = log
        if batch.end and set(batch.end) <= set(batch.start):  # nothing before the least start: the scan can skip it
            least = F.timestamp_micros(F.lit(min(batch.start.values())))
            rows = rows.where(F.col("delivered_at").isNull() | (F.col("delivered_at") >= (least if dict(log.dtypes)["delivered_at"] == "timestamp" else least.cast("timestamp_ntz"))))
        return self._range(self.upto(rows, batch), batch, "start", upper=False)

    def _range(self, log: DataFrame, batch: Batch, side: str, upper: bool) -> DataFrame:
        """One offset per partition meets the log as a table; it is broadcast while it has no more than PARTITIONS rows."""
        limits = getattr(batch, side)
        bounds = self.spark.createDataFrame(list(limits.items()), "source string, __bound bigint")
        offset = F.unix_micros(F.col("delivered_at").cast("timestamp"))
        joined = log.join(F.broadcast(bounds) if len(limits) <= PARTITIONS else bounds, "source", "left")
        # a delivery without a time is in every batch: it can't be placed, and the sink removes repeats
        inside = (offset <= F.col("__bound")) if upper else (F.col("__bound").isNull() | (offset > F.col("__bound")))
        return joined.where(offset.isNull() | inside).select(*log.columns)


class DedupSink:
    """Appends a batch under its number (idempotent) and reads each key's latest row once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, root + "/sink"

    def write(self, rows: DataFrame, batch: Batch) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch.number}")

    def read(self, order: tuple[str, ...] = ("offset", "batch")) -> DataFrame:
        """Each key's greatest row by ``order``, once, however often and in whatever batches it came."""
        rows = self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*")
        rest = [c for c in rows.columns if c not in (*KEY, *order)]
        last = rows.groupBy(*KEY).agg(F.max(F.struct(*order, *rest)).alias("__b"))
        return last.select(*KEY, *(F.col(f"__b.{c}").alias(c) for c in rows.columns if c not in (*KEY, "batch")))


def ok_offsets(runs: DataFrame) -> dict[str, int]:
    """Per source, the start of its latest run that ended well, as an offset: what was delivered before, that run could see."""
    if "started_at" not in runs.columns:
        return {}
    last = runs.where("status = 'ok' AND source IS NOT NULL AND started_at IS NOT NULL").groupBy("source").agg(F.max(F.unix_micros(F.col("started_at").cast("timestamp"))).alias("at"))
    return {r["source"]: r["at"] for r in last.collect()}


def capture_changes(capture: ChangeCapture, sink: DedupSink, log: DataFrame, stops: tuple[dict[str, int], ...] = ()) -> list[Batch]:
    """Takes the log into the sink in batches: one up to each of ``stops``, one up to the log's end.

    Each batch is planned, read between its own offsets only, folded to a row a key, written and committed. A
    batch that an earlier process planned and did not commit comes first, with the offsets it had.
    """
    done = []
    left: list[dict[str, int] | None] = [*(s for s in stops if s), None]
    while left:
        batch = capture.plan(log, left[0])
        if not batch.replayed:
            left.pop(0)
        if batch.start != batch.end or batch.replayed or not left:
            sink.write(current_rows(capture.changes(log, batch)).select(*KEY, "modified_at", "version", "offset"), batch)
        else:
            sink.write(current_rows(log.limit(0)).select(*KEY, "modified_at", "version", "offset"), batch)
        capture.commit(batch)
        done.append(batch)
    return done


def next_run(capture: ChangeCapture, artifacts: DataFrame, ledger: DataFrame, runs: DataFrame, corpora: DataFrame) -> tuple[Batch, DataFrame]:
    """Takes in what was delivered since the last call and gives what the next run must process.

    The sink holds the current version of every artifact, by key and offset. A fresh one is filled up to what
    the latest good runs could see first; from then on a call reads the deliveries after its last committed
    offsets and no others. What the ledger does not hold as of a good run (its content is new, its embedder or
    strategy has changed, its run failed) is pending.
    """
    sink = DedupSink(capture.spark, capture.root)
    batches = capture_changes(capture, sink, artifacts, () if capture.committed_offsets() else (ok_offsets(runs),))
    return batches[-1], pending(sink.read(order=("modified_at", "version")), ledger, runs, corpora)
