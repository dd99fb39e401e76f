from datetime import datetime, timedelta
from hashlib import sha256

import pytest

from corpusmill.operators import changelog
from corpusmill.runtime import SharedFiles, scratch_path

T0 = datetime(2024, 1, 1)
ARTIFACTS = "source string, artifact_id string, raw string, modified_at timestamp, delivered_at timestamp"
LEDGER = "source string, artifact_id string, version string, embedder_id string, strategy_id string, run_id bigint, written_at timestamp"
RUNS = "run_id bigint, source string, status string"


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def frames(spark, artifacts, ledger, runs):
    a = spark.createDataFrame([(s, i, raw, at(m), at(d)) for s, i, raw, m, d in artifacts], ARTIFACTS)
    v = spark.createDataFrame([(s, i, sha256(raw.encode()).hexdigest(), e, g, r, at(r)) for s, i, raw, e, g, r in ledger], LEDGER)
    return a, v, spark.createDataFrame(runs, RUNS), spark.createDataFrame([("s", "e1", "g1")], "source string, embedder_id string, strategy_id string")


def pending(spark, artifacts, ledger, runs):
    capture = changelog.ChangeCapture(spark, scratch_path(spark, "wal"))
    _, df = changelog.next_run(capture, *frames(spark, artifacts, ledger, runs))
    return {(r.artifact_id, r.reason) for r in df.collect()}


RUNS_OK = [(1, "s", "ok"), (2, "s", "failed"), (3, "s", "crashed")]


def test_reasons(spark):
    artifacts = [
        ("s", "same", "x", 1, 1), ("s", "new", "x", 1, 1), ("s", "edited", "y", 2, 2), ("s", "edited", "x", 1, 1), ("s", "late", "old", 1, 9), ("s", "late", "x", 5, 5),
        ("s", "embedder", "x", 1, 1), ("s", "strategy", "x", 1, 1), ("s", "null", None, 1, 1), ("s", "empty", "", 1, 1), ("s", "failed", "x", 1, 1), ("s", "newer bad", "x", 1, 1),
        ("s", "same", "x", 1, 3),
    ]
    ledger = [
        ("s", "same", "x", "e1", "g1", 1), ("s", "same", "x", "e1", "g1", 1), ("s", "edited", "x", "e1", "g1", 1), ("s", "late", "x", "e1", "g1", 1), ("s", "embedder", "x", "e0", "g1", 1),
        ("s", "strategy", "x", "e1", "g0", 1), ("s", "failed", "x", "e1", "g1", 2), ("s", "newer bad", "x", "e1", "g1", 1), ("s", "newer bad", "z", "e1", "g1", 3), ("s", "gone", "x", "e1", "g1", 1),
    ]
    assert pending(spark, artifacts, ledger, RUNS_OK) == {("new", "new"), ("edited", "content"), ("embedder", "embedder"), ("strategy", "strategy"), ("empty", "new"), ("failed", "new")}


def test_empty_tables(spark):
    assert pending(spark, [], [], []) == set()
    assert pending(spark, [("s", "a", "x", None, None)], [], []) == {("a", "new")}


def test_failure_replays_the_same_batch(spark):
    root = scratch_path(spark, "wal")
    first, *rest = frames(spark, [("s", "a", "x", 1, 1), ("t", "b", "x", 1, 2)], [], [])
    capture = changelog.ChangeCapture(spark, root)
    batch = capture.plan(first)
    assert batch.number == 0 and batch.start == {} and not batch.replayed
    # the run dies; more is delivered; the next process finds the plan and takes exactly the same range
    more = first.union(frames(spark, [("s", "c", "x", 3, 3)], [], [])[0])
    again = changelog.ChangeCapture(spark, root)
    replay = again.plan(more)
    assert replay.replayed and replay.end == batch.end
    assert {r.artifact_id for r in again.changes(more, replay).collect()} == {"a", "b"}
    sink = changelog.DedupSink(spark, root)
    for _ in range(2):  # half a try, then the whole one
        sink.write(changelog.current_rows(again.changes(more, replay)).select("source", "artifact_id", "offset", "version"), replay)
    again.commit(replay)
    again.commit(replay)
    after = again.plan(more)
    assert after.number == 1 and {r.artifact_id for r in again.changes(more, after).collect()} == {"c"}
    sink.write(changelog.current_rows(again.changes(more, after)).select("source", "artifact_id", "offset", "version"), after)
    assert sorted(r.artifact_id for r in sink.read().collect()) == ["a", "b", "c"]


def test_two_planners_cannot_publish_one_batch(spark):
    root = scratch_path(spark, "wal")
    files = SharedFiles(spark, root)
    files.publish("plan-0.json", "{}")
    with pytest.raises(OSError):
        files.publish("plan-0.json", "{}")


def test_a_second_call_reads_only_what_was_delivered_since(spark):
    """Two committed runs and a crashed one over one table: each reads its own deliveries, the sink has each key once."""
    root = scratch_path(spark, "wal")
    rows = [("s", "a", "x", 1, 1), ("s", "b", "x", 1, 2), ("t", "c", "x", 1, 2), ("s", "timeless", "x", 1, None)]
    log, ledger, runs, corpora = frames(spark, rows, [("s", "a", "x", "e1", "g1", 1)], RUNS_OK)
    capture = changelog.ChangeCapture(spark, root)
    first, df = changelog.next_run(capture, log, ledger, runs, corpora)
    assert first.start == {} and {r.artifact_id for r in df.collect()} == {"b", "c", "timeless"}
    # old content delivered late, a change, a new source; the process dies after planning
    more = log.union(frames(spark, [("s", "a", "old", 0, 5), ("s", "b", "y", 6, 6), ("u", "d", "x", 1, 1)], [], [])[0])
    planned = changelog.ChangeCapture(spark, root).plan(more)
    last = more.union(frames(spark, [("s", "e", "x", 7, 7)], [], [])[0])
    after, df = changelog.next_run(changelog.ChangeCapture(spark, root), last, ledger, runs, corpora)
    assert {r.artifact_id for r in df.collect()} == {"b", "c", "d", "e", "timeless"} and after.start == planned.end
    read = {n: {r.artifact_id for r in spark.read.parquet(f"{root}/sink/batch={n}").collect()} for n in range(3)}
    assert read == {0: {"a", "b", "c", "timeless"}, 1: {"a", "b", "d", "timeless"}, 2: {"e", "timeless"}}
    versions = {r.artifact_id: r.version for r in changelog.DedupSink(spark, root).read(("modified_at", "version")).collect()}
    assert versions["a"] == sha256(b"x").hexdigest() and versions["b"] == sha256(b"y").hexdigest() and len(versions) == 6


def test_a_fresh_state_is_filled_up_to_the_good_runs_first(spark):
    log, ledger, _, corpora = frames(spark, [("s", "a", "x", 1, 1), ("s", "b", "x", 4, 4), ("t", "c", "x", 1, 1)], [("s", "a", "x", "e1", "g1", 1)], [])
    runs = spark.createDataFrame([(1, "s", "ok", at(2)), (2, "s", "failed", at(3))], RUNS + ", started_at timestamp")
    root = scratch_path(spark, "wal")
    _, df = changelog.next_run(changelog.ChangeCapture(spark, root), log, ledger, runs, corpora)
    assert {r.artifact_id for r in df.collect()} == {"b", "c"}
    assert {r.artifact_id for r in spark.read.parquet(f"{root}/sink/batch=0").collect()} == {"a"}
    assert {r.artifact_id for r in spark.read.parquet(f"{root}/sink/batch=1").collect()} == {"b", "c"}
