"""Evaluation cases on disk: JSON lines with a ``__meta__`` header, and identities of reranked configurations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import SharedFiles

CASE = "query string, gold array<string>, corpus string, source_id string, __meta__ string"


def save_cases(spark: SparkSession, folder: str, name: str, cases: Iterable[Mapping], meta: Mapping | None = None) -> str:
    """One file of hand-sized cases: a header line, then a case a line. Replaces an older one."""
    files = SharedFiles(spark, folder)
    lines = [json.dumps({"__meta__": dict(meta or {})}, sort_keys=True), *(json.dumps(dict(c), ensure_ascii=False, sort_keys=True) for c in cases)]
    file = f"{name}.jsonl"
    files.replace(file, "\n".join(lines) + "\n")
    return f"{folder.rstrip('/')}/{file}"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, query, gold, corpus, source_id)``; ``qid`` is stable for a query and its gold."""
    rows = spark.read.schema(CASE).json(path).where("__meta__ IS NULL AND query IS NOT NULL").drop("__meta__")
    gold = F.coalesce("gold", F.array().cast("array<string>"))
    return rows.select(F.xxhash64("query", F.array_join(gold, "\x1f")).alias("qid"), "query", gold.alias("gold"), "corpus", "source_id")


def read_meta(spark: SparkSession, path: str) -> dict:
    head = spark.read.text(path).where(F.col("value").contains('"__meta__"')).limit(1).collect()
    return json.loads(head[0].value)["__meta__"] if head else {}


def gold_rows(cases: DataFrame) -> DataFrame:
    """``(qid, artifact_id)``: one row per gold id (none for abstention cases)."""
    return cases.select("qid", F.explode("gold").alias("artifact_id")).distinct()


def rerank_tag(rerank: Callable | str | None, max_chars: int | None = None) -> str:
    """A short name of a reranker for calibration keys; an unnamed function has none and may not be calibrated."""
    if rerank is None:
        return ""
    name = rerank if isinstance(rerank, str) else getattr(rerank, "__name__", "")
    if not name or name == "<lambda>":
        raise ValueError("an anonymous reranker can't be named in a calibration key")
    tag = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")
    return f"{tag}@{max_chars}" if max_chars else tag


def calibration_key(mode: str, tag: str = "") -> str:
    return f"{mode}+{tag}" if tag else mode
