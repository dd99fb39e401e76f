"""Sources: everything that yields ``artifacts`` (``source, artifact_id``, content columns, metadata columns).

A source is a lazy DataFrame with a strategy and a change signal; the scan is the DataFrame itself, so
column pruning and filters reach whatever it reads from.
"""

from __future__ import annotations

import importlib
import os
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import content_hash
from corpusmill.operators.surfaces import Chunked, Package, Skill, Strategy, Turn, WholeText


@dataclass(frozen=True)
class CorpusSource:
    """A named scan: its rows, how they are decomposed, what counts as a change, which columns are metadata."""

    name: str
    rows: DataFrame
    strategy: Strategy = field(default_factory=WholeText)
    change_signal: Column | None = None
    metadata: tuple[str, ...] = ()
    embedder: str = "hashing__dim512"

    def items(self) -> DataFrame:
        return self.rows

    def versioned(self) -> DataFrame:
        """The rows with ``version``: the hash of the text unless a signal of its own is given."""
        signal = self.change_signal if self.change_signal is not None else content_hash(F.col("text"))
        return self.rows.withColumn("version", signal)


def resolve(reference: Callable | str) -> Callable:
    """A callable, or ``"package.module:attribute"``."""
    if callable(reference):
        return reference
    module, _, attribute = reference.partition(":")
    if not attribute:
        module, _, attribute = reference.rpartition(".")
    found = getattr(importlib.import_module(module), attribute)
    if not callable(found):
        raise TypeError(f"{reference!r} is no callable")
    return found


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last by ``order``: a partial aggregate over the whole row, no window."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(order.alias("__o"), *rest)).alias("__last"))
    return last.select(*keys, *(F.col(f"__last.`{c}`").alias(c) for c in rest))


def from_mapping(spark: SparkSession, mapping: Mapping[str, str], name: str, strategy: Strategy | None = None) -> CorpusSource:
    rows = spark.createDataFrame([(name, k, v) for k, v in mapping.items()], "source string, artifact_id string, text string")
    return CorpusSource(name, rows, strategy or WholeText())


def from_records(rows: DataFrame, name: str, position: str, id_key: str = "id", text_key: str = "text", metadata: Iterable[str] = (), strategy: Strategy | None = None) -> CorpusSource:
    """Records of any shape: an empty id becomes ``<name>_<position>``, a later row replaces an earlier one of its id."""
    own = F.coalesce(F.nullif(F.col(id_key).cast("string"), F.lit("")), F.concat(F.lit(f"{name}_"), F.col(position).cast("string")))
    kept = rows.select(F.lit(name).alias("source"), own.alias("artifact_id"), F.col(text_key).alias("text"), F.col(position).alias("__at"), *metadata)
    return CorpusSource(name, last_wins(kept, ["source", "artifact_id"], F.col("__at")).drop("__at"), strategy or Chunked(), metadata=tuple(metadata))


def from_files(spark: SparkSession, root: str, name: str, pattern: str = r".*\.md$", exclude: str | None = None) -> CorpusSource:
    """Text files under a folder whose relative path matches; ids are relative paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    relative = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(os.path.abspath(base)) + 2})") if "://" not in root else F.regexp_replace("path", "^" + re.escape(base), "")
    rows = files.select(F.lit(name).alias("source"), relative.alias("artifact_id"), F.decode("content", "UTF-8").alias("text"), path.alias("path"))
    rows = rows.where(F.col("artifact_id").rlike(f"^(?:{pattern})$") if pattern else F.lit(True))
    if exclude:
        rows = rows.where(~F.col("artifact_id").rlike(exclude))
    rows = rows.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return CorpusSource(name, rows, Chunked(), metadata=("path", "filename"))


#: Folders that hold other people's or generated files.
VENDORED = ("node_modules", "site-packages", "venv", ".venv", "build", "dist", "__pycache__")


def report_exclusion(path: Column, excluded: Iterable[str] = VENDORED) -> Column:
    """Why a report is left out: ``allcaps`` (a name in capitals), ``excluded_dir`` (also dotted folders), else null."""
    parts = F.split(path, "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.md$", "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.exists(folders, lambda d: d.isin(list(excluded)) | d.startswith("."))
    return F.when(name.rlike(r"^[^a-z]*[A-Z][^a-z]*$"), "allcaps").when(bad, "excluded_dir")


def reports(rows: DataFrame, path: str = "path", text: str = "text", name: str = "reports", excluded: Iterable[str] = VENDORED) -> CorpusSource:
    """Markdown reports below ``<project>/docs`` and ``<project>/misc/docs``, however deep; blank and excluded ones drop out."""
    kept = rows.where(F.col(path).rlike(r"(?:^|/)(?:misc/)?docs/(?:[^/]+/)*[^/]+\.md$") & report_exclusion(F.col(path), excluded).isNull() & (F.btrim(F.col(text)) != ""))
    parts = F.split(F.col(path), "/")
    out = kept.select(F.lit(name).alias("source"), F.col(path).alias("artifact_id"), F.col(text).alias("text"), F.element_at(parts, 1).alias("project"), F.element_at(parts, -1).alias("filename"))
    return CorpusSource(name, out, Chunked(), metadata=("project", "filename"))


def with_collisions(rows: DataFrame, name: str, parent: str, order: str) -> Column:
    """The id of a named row: its name, or ``name@parent`` from the second row of that name on."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return F.when(nth > 1, F.concat_ws("@", F.col(name), F.col(parent))).otherwise(F.col(name))


def skills(rows: DataFrame, order: str, name: str = "skills") -> CorpusSource:
    """``name, description, parent`` rows; a third row of the same name and parent replaces the second."""
    named = rows.withColumn("artifact_id", with_collisions(rows, "name", "parent", order)).withColumn("source", F.lit(name))
    last = last_wins(named.select("source", "artifact_id", "name", "description", "parent", order), ["source", "artifact_id"], F.col(order))
    return CorpusSource(name, last, Skill(), metadata=("name", "parent"))


def tools(rows: DataFrame, spec: str = "spec", name: str = "tools", check: bool = True) -> CorpusSource:
    """Tool specifications in JSON: name and description are embedded, the schema only counts as change.

    Names that occur twice raise (an action; ``check=False`` leaves that to the caller).
    """
    j = F.col(spec)
    get = lambda key: F.get_json_object(j, f"$.{key}")
    schema = F.coalesce(get("parameters"), get("inputSchema"), get("input_schema"))
    properties = F.coalesce(F.get_json_object(schema, "$.properties"), schema)
    params = F.array_sort(F.coalesce(F.json_object_keys(properties), F.array().cast("array<string>")))
    out = rows.select(
        F.lit(name).alias("source"), get("name").alias("artifact_id"), get("name").alias("name"), get("description").alias("description"),
        F.array_join(params, ",").alias("param_names"), schema.alias("schema"),
        (F.try_parse_json(j).isNotNull() & j.rlike(r"\}\s*$")).alias("__valid"),  # both parsers stop at the closing brace
    ).where(F.col("artifact_id").isNotNull() & F.col("__valid")).drop("__valid")
    if check:
        twice = [r[0] for r in out.groupBy("artifact_id").count().where("count > 1").select("artifact_id").limit(5).collect()]
        if twice:
            raise ValueError(f"tool names occur twice, such as {twice}")
    signal = content_hash(F.concat_ws("\n", "name", "description"), F.col("schema"))
    return CorpusSource(name, out, Skill(), change_signal=signal, metadata=("name", "param_names"))


def sessions(turns: DataFrame, now: Column, since_days: int = 90, max_sessions: int | None = None, include_full: bool = False, name: str = "sessions") -> CorpusSource:
    """``session_id, turn, role, text, ts`` rows to question-and-answer pairs.

    A question is paired with the last answer before the next question. Sessions are the latest ones whose
    last turn is within the look-back.
    """
    from pyspark.sql import Window

    by_turn = Window.partitionBy("session_id").orderBy("turn")
    spoken = turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    recent = spoken.groupBy("session_id").agg(F.max("ts").alias("last")).where(F.col("last") >= now - F.expr(f"INTERVAL {since_days} DAYS"))
    if max_sessions is not None:
        recent = recent.orderBy(F.col("last").desc(), "session_id").limit(max_sessions)
    numbered = spoken.join(recent, "session_id").withColumn("pair", F.count(F.when(F.col("role") == "user", 1)).over(by_turn)).where("pair > 0")
    said = numbered.groupBy("session_id", "pair").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_prompt"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_text"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("answered"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("answers"),
    )
    answer = F.when(F.col("answered").isNotNull(), F.col("last_text"))
    out = said.select(
        F.lit(name).alias("source"), F.concat_ws("#", F.col("session_id").cast("string"), F.col("pair").cast("string")).alias("artifact_id"),
        "user_prompt", answer.alias("assistant_summary"), F.array_join(F.transform("answers", lambda a: a["text"]), "\n\n").alias("assistant_full"),
        F.lit(None).cast("string").alias("session_title"), F.lit("turn").alias("record_type"), F.col("session_id").cast("string").alias("session_id"),
    )
    return CorpusSource(name, out, Turn(include_full), metadata=("session_id",))


def packages(rows: DataFrame, order: str, readme_chars: int = 20_000, exclude: str | None = None, name: str = "packages") -> CorpusSource:
    """``name, parent, pyproject, setup_cfg, package_json, readme, deps`` rows: the first description found counts."""
    description = F.coalesce(*(F.nullif(F.btrim(F.col(c)), F.lit("")) for c in ("pyproject", "setup_cfg", "package_json")))
    kept = rows if exclude is None else rows.where(~F.col("name").rlike(exclude))
    out = kept.select(
        F.lit(name).alias("source"), with_collisions(kept, "name", "parent", order).alias("artifact_id"), "name", description.alias("description"),
        F.left("readme", F.lit(readme_chars)).alias("readme"), "deps", F.lit("ours").alias("owner"), F.coalesce(F.btrim("readme") != "", F.lit(False)).alias("has_readme"),
    )
    return CorpusSource(name, out, Package(), metadata=("name", "owner", "has_readme", "deps"))


def coverage(found: DataFrame, indexed: DataFrame, keys: list[str], by: str, reason: Column | None = None) -> DataFrame:
    """Per group: how many of the found artifacts are indexed, missing or excluded, and indexed / (indexed + missing)."""
    has = indexed.select(*keys).distinct().withColumn("__in", F.lit(True))
    why = reason if reason is not None else F.lit(None).cast("string")
    joined = found.withColumn("__why", why).join(has, keys, "left")
    state = F.when(F.col("__why").isNotNull(), "excluded").when(F.col("__in"), "indexed").otherwise("missing")
    out = joined.groupBy(by).agg(*(F.count(F.when(state == s, 1)).alias(s) for s in ("indexed", "missing", "excluded")))
    whole = F.col("indexed") + F.col("missing")
    return out.withColumn("coverage_ratio", F.when(whole > 0, F.col("indexed") / whole).otherwise(F.lit(1.0)))
