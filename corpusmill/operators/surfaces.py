"""Decomposition of artifacts into surfaces (the texts that are indexed), as Column expressions.

A strategy turns ``artifacts`` (one row each) into surfaces ``(..., kind, granularity, surface_index, text)``
where ``surface_index`` is the position among all surfaces of the artifact, whatever their kind. Blank
surfaces are dropped before they are numbered.
"""

from __future__ import annotations

import importlib
import json
import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import blank, fold_text

STRIP = " \t\r\n"
SURFACE = "struct<kind:string,granularity:string,text:string>"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIP))


# --- chunks --------------------------------------------------------------------------------------


def hard_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last; blank ones dropped."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(step))
    cut = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.filter(F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>")), lambda p: strip(p) != "")


def chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Paragraphs packed greedily into chunks of ``size``, each begun with the last ``overlap`` characters before it.

    A text that fits is one chunk. A paragraph that does not fit by itself is cut into windows. The carried
    end comes on top of the paragraph it precedes, so such a chunk may exceed ``size`` by the overlap. One
    fold over the paragraphs, no Python.
    """
    whole = strip(text)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def add(acc: Column, paragraph: Column) -> Column:
        joined = F.when(acc["open"] == "", paragraph).otherwise(F.concat(acc["open"], F.lit("\n\n"), paragraph))
        carried = F.when((acc["open"] == "") | F.lit(overlap <= 0), paragraph).otherwise(strip(F.concat(F.right(acc["open"], F.lit(max(1, overlap))), F.lit("\n\n"), paragraph)))
        fits = F.length(joined) <= size
        too_long = F.length(paragraph) > size
        done = F.when(too_long, F.concat(flushed(acc), hard_windows(paragraph, size, overlap))).when(fits, acc["done"]).otherwise(flushed(acc))
        open_ = F.when(too_long, F.lit("")).when(fits, joined).otherwise(carried)
        return F.struct(done.alias("done"), open_.alias("open"))

    paragraphs = F.filter(F.transform(F.split(whole, r"\n\s*\n"), strip), lambda p: p != "")
    packed = F.aggregate(paragraphs, start, add, flushed)
    return F.when(text.isNull() | (whole == ""), none).when(F.length(whole) <= size, F.array(whole)).otherwise(packed)


def token_windows(text: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Windows of at most ``max_tokens`` words with their white space, in characters of the text."""
    words = F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))
    step = max(1, max_tokens - overlap_tokens)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - F.lit(overlap_tokens)), F.lit(step))
    cut = F.transform(starts, lambda i: strip(F.array_join(F.slice(words, i, F.lit(max_tokens)), "")))
    return F.filter(F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>")), lambda p: p != "")


def balanced_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """The fewest windows of the stripped text of nearly equal width, at most ``size``, that overlap by ``overlap``."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size must hold")
    text = strip(text)
    n_chars = F.length(text)
    n = F.greatest(F.lit(1), F.ceil((n_chars - overlap) / F.lit(float(size - overlap))).cast("int"))
    width = F.ceil((n_chars + (n - 1) * overlap) / n.cast("double")).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * (width - overlap) + 1, width))
    return F.when(n_chars > size, cut).when(n_chars > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


# --- strategies ----------------------------------------------------------------------------------


def surface(kind: str, granularity: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(granularity).alias("granularity"), text.alias("text"))


def _many(kind: str, granularity: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: surface(kind, granularity, t))


def explode_surfaces(artifacts: DataFrame, surfaces: Column, keep: list[str]) -> DataFrame:
    """One row per surface with its place; blank surfaces drop out first."""
    kept = F.filter(surfaces, lambda s: ~blank(s["text"]))
    rows = artifacts.select(*keep, F.posexplode(kept).alias("surface_index", "__s"))
    return rows.select(*keep, "surface_index", F.col("__s.kind").alias("surface_kind"), F.col("__s.granularity").alias("granularity"), F.col("__s.text").alias("text"))


class Strategy:
    """Turns a row's columns into an array of surfaces. Subclasses are frozen dataclasses of plain values."""

    def surfaces(self) -> Column:
        raise NotImplementedError

    def decompose(self, artifacts: DataFrame, keep: list[str]) -> DataFrame:
        return explode_surfaces(artifacts, self.surfaces(), keep)

    def spec(self) -> dict:
        """Class and parameters, nested strategies included: what two runs must share to agree."""
        out: dict = {"class": type(self).__name__}
        for f in sorted(fields(self), key=lambda f: f.name):  # type: ignore[arg-type]
            v = getattr(self, f.name)
            out[f.name] = v.spec() if isinstance(v, Strategy) else list(v) if isinstance(v, tuple) else v
        return out

    @property
    def id(self) -> str:
        return json.dumps(self.spec(), sort_keys=True, separators=(",", ":"))


def strategy_from_spec(spec: dict) -> Strategy:
    """The inverse of :meth:`Strategy.spec`."""
    kinds = {c.__name__: c for c in (WholeText, Chunked, Skill, Fields, Package, Turn, WithSynopsis)}
    if spec.get("class") not in kinds:
        raise ValueError(f"unknown strategy {spec.get('class')!r}")
    args = {k: strategy_from_spec(v) if isinstance(v, dict) and "class" in v else tuple(v) if isinstance(v, list) else v for k, v in spec.items() if k != "class"}
    return kinds[spec["class"]](**args)


@dataclass(frozen=True)
class WholeText(Strategy):
    text_key: str = "text"
    kind: str = "document"

    def surfaces(self) -> Column:
        return F.array(surface(self.kind, "document", F.col(self.text_key)))


@dataclass(frozen=True)
class Chunked(Strategy):
    chunk_size: int = 1200
    overlap: int = 200
    text_key: str = "text"
    kind: str = "chunk"
    max_tokens: int | None = None

    def surfaces(self) -> Column:
        text = F.col(self.text_key)
        if self.max_tokens:
            parts = token_windows(text, self.max_tokens, round(self.max_tokens * self.overlap / self.chunk_size))
        else:
            parts = chunks(text, self.chunk_size, self.overlap)
        return _many(self.kind, "chunk", parts)


@dataclass(frozen=True)
class Skill(Strategy):
    name_key: str = "name"
    description_key: str = "description"

    def surfaces(self) -> Column:
        text = F.concat(F.coalesce(F.col(self.name_key), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(self.description_key), F.lit("")))
        return F.array(surface("capability", "document", strip(text)))


@dataclass(frozen=True)
class Fields(Strategy):
    """A head and a windowed body per record (``layout='record'``), or a surface per field (``'fields'``)."""

    fields: tuple[str, ...]
    head: tuple[str, ...] = ()
    layout: str = "record"
    normalize: bool = False
    max_chars: int = 1200
    overlap: int = 200
    kind: str = "record"

    def _text(self, name: str) -> Column:
        value = strip(F.coalesce(F.col(name).cast("string"), F.lit("")))
        return fold_text(value) if self.normalize else value

    def surfaces(self) -> Column:
        if self.layout == "fields":
            return F.array(*(surface(f, "field", self._text(f)) for f in (*self.head, *self.fields)))
        if self.layout != "record":
            raise ValueError(f"unknown layout {self.layout!r}")

        def joined(names):
            texts = [self._text(n) for n in names]
            return F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n") if texts else F.lit("")

        head = joined(self.head)
        body = balanced_windows(joined(self.fields), self.max_chars, self.overlap)
        bodies = F.when(F.size(body) > 0, body).otherwise(F.array(F.lit("")))
        return _many(self.kind, "field", F.transform(bodies, lambda w: strip(F.concat(head, F.lit("\n"), w))))


@dataclass(frozen=True)
class Package(Strategy):
    """``description`` first, then the readme in chunks, then the dependencies if they are embedded."""

    chunk_size: int = 1500
    overlap: int = 200
    embed_deps: bool = False
    name_key: str = "name"
    description_key: str = "description"
    readme_key: str = "readme"
    deps_key: str = "deps"

    def surfaces(self) -> Column:
        description = F.coalesce(F.col(self.description_key), F.lit(""))
        title = F.when(description == "", F.lit("")).otherwise(F.concat(F.col(self.name_key), F.lit(": "), description))
        parts = F.concat(F.array(surface("description", "field", title)), _many("readme_chunk", "chunk", chunks(F.col(self.readme_key), self.chunk_size, self.overlap)))
        if self.embed_deps:
            deps = F.array_join(F.array_distinct(F.coalesce(F.col(self.deps_key), F.array().cast("array<string>"))), ", ")
            parts = F.concat(parts, F.array(surface("deps", "field", F.when(deps == "", F.lit("")).otherwise(F.concat(F.lit("Depends on: "), deps)))))
        return parts


@dataclass(frozen=True)
class Turn(Strategy):
    """Question and answer of a session turn, with the full answer if asked for and different, else the title."""

    include_full: bool = False

    def surfaces(self) -> Column:
        summary, full = F.coalesce(F.col("assistant_summary"), F.lit("")), F.coalesce(F.col("assistant_full"), F.lit(""))
        title = F.when(F.col("record_type") == "session", F.coalesce(F.col("session_title"), F.lit(""))).otherwise(F.lit(""))
        parts = [surface("user_prompt", "field", F.coalesce(F.col("user_prompt"), F.lit(""))), surface("assistant_summary", "field", summary)]
        if self.include_full:
            parts.append(surface("assistant_full", "document", F.when(full != summary, full).otherwise(F.lit(""))))
        return F.array(*parts, surface("session_title", "field", title))


def first_sentence(text: Column, most: int = 240) -> Column:
    """The extractive stand-in for a written synopsis."""
    found = F.regexp_extract(strip(F.coalesce(text, F.lit(""))), r"^(.*?[.!?])(?:\s|$)", 1)
    return F.left(F.when(found == "", strip(F.coalesce(text, F.lit("")))).otherwise(found), F.lit(most))


def thin_description(column: str = "description", min_chars: int = 40) -> Column:
    return F.length(strip(F.coalesce(F.col(column), F.lit("")))) < min_chars


@dataclass(frozen=True)
class WithSynopsis(Strategy):
    """Another strategy's surfaces after one derived surface, made where the gate column is true (or always)."""

    inner: Strategy
    text_key: str = "text"
    gate: str | None = None
    kind: str = "synopsis"
    #: The function of a Column that writes it, ``package.module:name``; part of the strategy's id, so another one reindexes.
    synthesizer: str = "corpusmill.operators.surfaces:first_sentence"

    def surfaces(self) -> Column:
        module, _, name = self.synthesizer.partition(":")
        text = getattr(importlib.import_module(module), name)(F.col(self.text_key))
        if self.gate:
            text = F.when(F.col(self.gate), text).otherwise(F.lit(""))
        return F.concat(F.array(surface(self.kind, "field", text)), self.inner.surfaces())


def windows_needed(length: int, size: int, overlap: int) -> int:
    """How many balanced windows a text of ``length`` gets (driver-side twin of :func:`balanced_windows`)."""
    return 0 if length == 0 else 1 if length <= size else math.ceil((length - overlap) / (size - overlap))
