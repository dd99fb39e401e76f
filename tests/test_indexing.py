from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import indexing, policy
from corpusmill.operators.surfaces import Chunked, WholeText
from corpusmill.runtime import scratch_path
from corpusmill.sources import corpus as sources
from corpusmill.sources.registry import Registry
from corpusmill.sources.store import CorpusStore
from corpusmill.streaming import incremental

ROWS = "source string, artifact_id string, text string"


def state(store):
    return sorted((r.artifact_id, r.text) for r in store.metas().collect())


def test_build_is_incremental_and_idempotent(spark):
    store = CorpusStore(spark, scratch_path(spark, "store"))
    with pytest.raises(FileNotFoundError):
        indexing.open_corpus(store)
    first = spark.createDataFrame([("s", "a", "one"), ("s", "b", "two"), ("s", "blank", " ")], ROWS)
    r = indexing.build(store, first, WholeText())
    assert (r.new, r.changed, r.vanished) == (3, 0, 0) and state(store) == [("a", "one"), ("b", "two")]
    snapshot = store.current()
    r = indexing.build(store, first, WholeText())
    assert (r.new, r.changed, r.unchanged) == (0, 0, 3) and store.current() == snapshot
    second = spark.createDataFrame([("s", "a", "one!"), ("s", "c", "three")], ROWS)
    r = indexing.build(store, second, WholeText())
    assert (r.new, r.changed, r.vanished) == (1, 1, 2) and state(store) == [("a", "one!"), ("c", "three")]
    r = indexing.build(store, second, Chunked())
    assert r.changed == 2 and {x.surface_kind for x in store.metas().collect()} == {"chunk"}
    part = spark.createDataFrame([("s", "d", "four")], ROWS)
    assert indexing.build(store, part, Chunked(), full=False).vanished == 0 and len(state(store)) == 3
    assert len(store.sweep()) == 3 and len(state(store)) == 3
    assert indexing.open_corpus(store)[1]["strategy"]["class"] == "Chunked"


def test_edges_vectors_and_documents(spark):
    store = CorpusStore(spark, scratch_path(spark, "store"))
    rows = spark.createDataFrame([("s", "a", "one")], ROWS)
    edges = spark.createDataFrame([("s", "a", "REF", 0, None, "b")], "source string, artifact_id string, edge_type string, pos int, target_source string, target_id string")
    indexing.build(store, rows, WholeText(), embed=lambda df: df.withColumn("vector", F.array(F.lit(3.0), F.lit(4.0)).cast("array<float>")), embedder_id="fixed", edges=edges)
    assert store.read("links").count() == 1
    assert store.matrix().first().vector == pytest.approx([0.6, 0.8])
    assert store.records_for(rows, "document").count() == 1
    store.put_document("calibration", {"hybrid": 0.3})
    assert store.get_document("calibration") == {"hybrid": 0.3} and store.get_document("none") is None
    with pytest.raises(ValueError):
        store.put_document("../x", {})


def test_stream_replays_do_not_repeat(spark, tmp_path):
    deliveries = spark.createDataFrame([("s", "a", "old", datetime(2024, 1, 1)), ("s", "a", "new", datetime(2024, 1, 2)), ("s", "b", "x", None)], ROWS + ", as_of timestamp")
    path = str(tmp_path / "in")
    deliveries.write.parquet(path)
    store, checkpoint = CorpusStore(spark, scratch_path(spark, "store")), scratch_path(spark, "stream")
    run = lambda: incremental.incremental_build(spark, incremental.file_stream(spark, path, deliveries.schema), store, WholeText(), checkpoint)
    run()
    assert state(store) == [("a", "new"), ("b", "x")]
    assert run() == []
    spark.createDataFrame([("s", "a", "late and old", datetime(2023, 1, 1)), ("s", "c", "y", datetime(2024, 1, 3))], deliveries.schema).write.mode("append").parquet(path)
    run()
    assert state(store) == [("a", "new"), ("b", "x"), ("c", "y")]


def test_registry_policy_and_lock(spark):
    store = CorpusStore(spark, scratch_path(spark, "store"))
    registry = Registry(store)
    registry.register("docs", kind="packages", reader="corpusmill.runtime:table", strategy=Chunked(800))
    assert registry.strategy_of("docs") == Chunked(800) and callable(registry.reader_of("docs")) and list(registry) == ["docs"]
    with pytest.raises(ValueError):
        registry.register("docs", kind="x")
    assert registry.unregister("docs") and not registry.unregister("docs")
    assert policy.resolve_policy("packages", {"every": "2d"})["reindex"] == "interval"
    with policy.single_run(store), pytest.raises(policy.MaintenanceBusy), policy.single_run(store):
        pass
    with policy.single_run(store):
        pass
    results = policy.maintain({"a": lambda: 1, "b": lambda: 1 / 0, "c": lambda: 2}, {"a": True, "b": True})
    assert [r.status for r in results] == ["ok", "failed", "skipped"]
    with pytest.raises(ZeroDivisionError):
        policy.maintain({"b": lambda: 1 / 0}, {}, only="b")


def test_sources(spark, tmp_path, rows):
    folder = tmp_path / "root" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("alpha")
    (folder / "b.txt").write_text("beta")
    files = sources.from_files(spark, str(tmp_path / "root"), "files").items()
    assert rows(files, "artifact_id", "text", "filename") == [("sub/a.md", "alpha", "a.md")]
    recs = spark.createDataFrame([("", "x", 0), ("i", "first", 1), ("i", "last", 2)], "id string, text string, n int")
    assert rows(sources.from_records(recs, "r", "n").items(), "artifact_id", "text") == [("i", "last"), ("r_0", "x")]
    skills = spark.createDataFrame([("n", "d1", "p", 1), ("n", "d2", "q", 2), ("n", "d3", "q", 3)], "name string, description string, parent string, o int")
    assert rows(sources.skills(skills, "o").items(), "artifact_id", "description") == [("n", "d1"), ("n@q", "d3")]
    with pytest.raises(ValueError):
        sources.tools(spark.createDataFrame([('{"name": "t", "description": "d"}',)] * 2, "spec string"))
    reason = spark.createDataFrame([("docs/READ_ME.md",), (".git/x.md",), ("docs/fine.md",)], "path string").select(sources.report_exclusion(F.col("path")))
    assert [r[0] for r in reason.collect()] == ["allcaps", "excluded_dir", None]
    assert sources.resolve("corpusmill.runtime:table") is sources.resolve("corpusmill.runtime.table")
