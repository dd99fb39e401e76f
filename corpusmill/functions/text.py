"""Scalar and array functions on text, as Column expressions (JVM-side) unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms everywhere in the library: longest runs of letters, digits and underscores, lower-cased.
TERM_PATTERN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """The terms of a text in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | (F.btrim(text, F.lit(" \t\r\n")) == "")


def storage_key(*parts: Column, length: int = 24) -> Column:
    """A stable id: the first hex digits of the SHA-256 of the parts joined by the unit separator."""
    return F.left(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), F.lit(length))


def content_hash(text: Column, *extra: Column) -> Column:
    """The version of a content: SHA-256 of the text, or of the text and further fields (nulls as empty)."""
    if not extra:
        return F.sha2(text, 256)
    return F.sha2(F.concat_ws("\x1f", F.coalesce(text, F.lit("")), *(F.coalesce(e.cast("string"), F.lit("")) for e in extra)), 256)


def canonical_set(values: Column) -> Column:
    """An array as a set with one spelling: distinct, sorted, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def dist_name(requirement: Column) -> Column:
    """The normalised distribution name of a requirement: bare name, lower case, runs of ``-_.`` as one ``-``."""
    bare = F.element_at(F.split(F.btrim(requirement), r"[<>=!~;@\[\s(,]"), 1)
    return F.regexp_replace(F.lower(bare), r"[-_.]+", "-")


def dep_name(requirement: Column) -> Column:
    """The bare lower-case name of a requirement, separators kept."""
    return F.lower(F.element_at(F.split(F.btrim(requirement), r"[<>=!~;@\[\s(,]"), 1))


def safe_name(name: Column) -> Column:
    """A name fit for a path: everything but letters, digits, ``._-`` becomes ``_``."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def sigmoid(x: Column) -> Column:
    """Logistic function, clamped at 60 either side; NaN and null give 0."""
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(1.0 / (1.0 + F.exp(-z)))


def recency(at: Column, now: Column, half_life_days: float) -> Column:
    """``0.5 ** (age / half life)``; the future counts as now, an unknown time as weight 1."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    age = F.greatest(F.lit(0.0), seconds / F.lit(86_400e6))
    return F.when(at.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), age / F.lit(float(half_life_days))))


def pointer(*candidates: Column) -> Column:
    """The first field that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in candidates))


def mentions(text: Column, term: Column) -> Column:
    """Whether a text holds a phrase as whole words, whatever the case; white space alone parts its words."""
    words = F.filter(F.split(F.lower(term), r"\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.array_join(quoted, r"\s+"), F.lit(r"(?![\p{L}\p{N}_])"))
    return F.coalesce((F.size(words) > 0) & F.regexp_like(F.lower(text), pattern), F.lit(False))


# --- with Python ---------------------------------------------------------------------------------

#: Letters that no decomposition reaches.
_PLAIN = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th"}


def fold_string(text: str | None) -> str | None:
    """Compatibility form, case folded, accents of Latin and Greek letters removed (others keep theirs)."""
    if text is None or text.isascii():
        return None if text is None else text.casefold()
    out, base = [], ""
    for ch in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold()):
        if unicodedata.combining(ch):
            if not base or not unicodedata.name(base, "").startswith(("LATIN", "GREEK")):
                out.append(ch)
        else:
            base = ch
            out.append(_PLAIN.get(ch, ch))
    return unicodedata.normalize("NFC", "".join(out))


def overlap_length(left: str, right: str, least: int = 8) -> int:
    """Length of the longest end of ``left`` that begins ``right`` (at least ``least``), else 0; linear by the prefix function."""
    at = left.find(right[:least], max(0, len(left) - len(right)))
    if at < 0:
        return 0
    tail, k = left[at:], 0
    if right.startswith(tail):
        return len(tail) if len(tail) >= least else 0
    back = [0] * len(tail)  # of each beginning of right, its longest proper end that is a beginning too
    for i in range(1, len(tail)):
        while k and right[k] != right[i]:
            k = back[k - 1]
        k += right[k] == right[i]
        back[i] = k
    k = 0
    for c in tail:
        while k and right[k] != c:
            k = back[k - 1]
        k += right[k] == c
    return k if k >= least else 0


def longest_overlap(left: Column, right: Column, least: int = 8) -> Column:
    """:func:`overlap_length` in Arrow batches, 0 for nulls."""
    @F.pandas_udf(T.IntegerType())
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([overlap_length(x, y, least) if x and y else 0 for x, y in zip(a, b)], dtype="int32")

    return shared(left, right)


def fold_text(text: Column) -> Column:
    """:func:`fold_string` in Arrow batches; ASCII rows take the JVM path."""
    @F.pandas_udf(T.StringType())
    def folded(s: pd.Series) -> pd.Series:
        return s.map(fold_string, na_action="ignore")

    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(folded(text))


# --- on the driver -------------------------------------------------------------------------------

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def parse_every(text: str) -> timedelta:
    """``15m``, ``6h``, ``1d`` ... ``hourly``, ``daily``, ``weekly`` as an interval."""
    named = {"hourly": "1h", "daily": "1d", "weekly": "1w"}
    m = re.fullmatch(r"(\d+)\s*([smhdw])", named.get(text.strip().lower(), text.strip().lower()))
    if not m or not int(m.group(1)):
        raise ValueError(f"no interval: {text!r}")
    return timedelta(seconds=int(m.group(1)) * _UNITS[m.group(2)])


def format_every(every: timedelta) -> str:
    seconds = int(every.total_seconds())
    for unit in ("w", "d", "h", "m"):
        if seconds % _UNITS[unit] == 0:
            return f"{seconds // _UNITS[unit]}{unit}"
    return f"{seconds}s"
