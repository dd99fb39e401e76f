"""An index-free ranker: matching lines, weighted by source and by age."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import recency

SNIPPET_CHARS = 200


def lines(text: Column) -> Column:
    """Lines by LF only; a CR at their end and a byte order mark at the start don't count."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\ufeff", "")
    return F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))


def line_pattern(pattern: str, fixed: bool = False, ignore_case: bool = True) -> str:
    """The Java pattern of a regular expression or literal; a bad pattern raises here."""
    re.compile(re.escape(pattern) if fixed else pattern)
    body = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E" if fixed else pattern
    return ("(?iu)" if ignore_case else "") + body


def prefilter(text: Column, pattern: str, fixed: bool, ignore_case: bool) -> Column:
    """A cheap test that no match can fail: only for literals that are ASCII and keep their length and letters when folded."""
    safe = fixed and pattern.isascii() and "\n" not in pattern and not (ignore_case and re.search("[iksIKS]", pattern))
    if not safe:
        return F.lit(True)
    return F.contains(F.lower(text), F.lit(pattern.lower())) if ignore_case else F.contains(text, F.lit(pattern))


def glob_column(path: Column, pattern: str) -> Column:
    """A file name pattern on the whole path; ``*`` crosses ``/``."""
    return path.rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$"))


def grep(
    rows: DataFrame, pattern: str, *, id_key: str = "artifact_id", text: str = "text", fixed: bool = False, ignore_case: bool = True, weight: Column | None = None,
    at: str | None = None, now: Column | None = None, half_life_days: float | None = None, k: int | None = 10,
) -> DataFrame:
    """``(id, score, n_lines, snippet)`` by falling score, then id. Filters on ``rows`` come before any text is read."""
    if (half_life_days is None) != (at is None):
        raise ValueError("a half life needs a time column, and the other way round")
    p = line_pattern(pattern, fixed, ignore_case)
    kept = rows.where(prefilter(F.col(text), pattern, fixed, ignore_case) & F.col(text).rlike("(?m)" + p))
    matching = F.filter(lines(F.col(text)), lambda x: x.rlike(p))
    found = kept.select(id_key, matching.alias("__m"), *(c for c in rows.columns if c not in (id_key, text))).where(F.size("__m") > 0)
    score = F.size("__m").cast("double") * (weight if weight is not None else F.lit(1.0))
    if half_life_days is not None:
        score = score * recency(F.col(at), now if now is not None else F.current_timestamp(), half_life_days)
    snippet = F.left(F.btrim(F.element_at("__m", 1), F.lit(" \t\r\n")), F.lit(SNIPPET_CHARS))
    out = found.select(id_key, F.round(score, 9).alias("score"), F.size("__m").cast("bigint").alias("n_lines"), snippet.alias("snippet"))
    return out if k is None else out.orderBy(F.col("score").desc(), id_key).limit(k)
