"""Query formulation: a ledger of equivalent terms, expansion of queries, and replay of the ledger's worth.

A ledger entry is ``{entry, terms, oneway, corpus, status}``. Expansion swaps one term at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = "entry int, terms array<string>, oneway boolean, corpus string, status string"
MAX_VARIANTS = 6
#: So many swaps of a ledger are broadcast to the queries.
LEDGER_ROWS = 10_000


def parse_ledger(text_lines: Iterable[str]) -> list[dict]:
    """Entries of a JSON-lines ledger; malformed and demoted ones, and entries with fewer than two terms, are passed over."""
    out = []
    for line in text_lines:
        try:
            entry = json.loads(line)
        except ValueError:
            continue
        terms = [t for t in entry.get("terms", []) if isinstance(t, str) and t.strip()] if isinstance(entry, dict) else []
        if len(terms) >= 2 and entry.get("status") != "demoted":
            out.append({"entry": len(out), "terms": terms, "oneway": bool(entry.get("oneway")), "corpus": entry.get("corpus"), "status": entry.get("status")})
    return out


def ledger(spark: SparkSession, entries: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([(e["entry"], e["terms"], e["oneway"], e.get("corpus"), e.get("status")) for e in entries], LEDGER)


def load_ledger(spark: SparkSession, path: str, corpus: str | None = None) -> DataFrame:
    """A ledger file, entries of other corpora left out."""
    read = [r.value for r in spark.read.text(path).collect()]  # hand-written, a line an entry
    return ledger(spark, (e for e in parse_ledger(read) if e["corpus"] in (None, corpus)))


def spelling(term: Column) -> Column:
    """Terms are the same whatever separates their words."""
    return F.btrim(F.regexp_replace(F.lower(term), r"[-_\s]+", " "))


#: A term of one word and so many characters at most is matched as a whole word only.
SHORT_TERM = 4


def term_regex(*terms: str) -> str:
    """A pattern for any of the terms, the longest first: one separator or none between the words of a term."""
    made: dict[str, str] = {}
    for term in sorted({t for t in terms if t.strip()}, key=lambda t: (-len(t), t)):
        body = "[-_ ]?".join(re.escape(w) for w in re.split(r"[-_\s]+", term.strip()) if w)
        short = len(term) <= SHORT_TERM and re.fullmatch(r"\w+", term)
        body = rf"\b{body}\b" if short else body
        made.setdefault(body.lower(), body)
    return "(?i)" + "|".join(made.values())


def term_pattern(term: Column) -> Column:
    """A term as a Column's pattern: whole words, whatever the case, one separator or none between them."""
    words = F.filter(F.split(F.btrim(term), r"[-_\s]+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), F.array_join(quoted, "[-_ ]?"), F.lit(r"(?![\p{L}\p{N}_])"))


def pairs(entries: DataFrame) -> DataFrame:
    """``(entry, from_term, from_pos, to_term, to_pos)``: the swaps that the ledger allows (from the first term only if one-way)."""
    a = entries.select("entry", "oneway", F.posexplode("terms").alias("from_pos", "from_term"))
    b = entries.select("entry", F.posexplode("terms").alias("to_pos", "to_term"))
    allowed = (F.col("from_pos") != F.col("to_pos")) & (~F.col("oneway") | (F.col("from_pos") == 0)) & (spelling(F.col("from_term")) != spelling(F.col("to_term")))
    once = F.row_number().over(Window.partitionBy("entry", "from_pos", spelling(F.col("to_term"))).orderBy("to_pos"))
    return a.join(b, "entry").where(allowed).drop("oneway").withColumn("__n", once).where("__n = 1").drop("__n")


def aliases(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, alias, place)``: a term itself, then its equivalents in ledger order."""
    asked = terms.select("term", spelling(F.col("term")).alias("__s")).distinct()
    swaps = pairs(entries).select("entry", "to_pos", F.col("to_term").alias("alias"), spelling(F.col("from_term")).alias("__s"))
    found = asked.join(swaps, "__s").groupBy("term", "alias").agg(F.min(F.struct("entry", "to_pos")).alias("o"))
    every = found.unionByName(asked.select("term", F.col("term").alias("alias"), F.struct(F.lit(-1).alias("entry"), F.lit(0).alias("to_pos")).alias("o")))
    return every.select("term", "alias", F.row_number().over(Window.partitionBy("term").orderBy("o", "alias")).alias("place"))


def expand_queries(queries: DataFrame, entries: DataFrame, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """``(qid, variant, text)``: the original as variant 0, then one-term swaps, ``max_variants`` rows at most.

    Per entry the longest of its terms that occurs as whole words is swapped, where it first occurs. The ledger
    is hand-written and counted: up to ``LEDGER_ROWS`` swaps are broadcast, and they meet the queries in a nested
    loop, as a pattern match has no join key.
    """
    swaps = pairs(entries).withColumn("__p", term_pattern(F.col("from_term")))
    swaps = F.broadcast(swaps) if swaps.limit(LEDGER_ROWS + 1).count() <= LEDGER_ROWS else swaps
    hit = queries.select("qid", "text").join(swaps, F.expr("text RLIKE __p"))
    first = F.min(F.struct(-F.length("from_term"), "from_pos")).over(Window.partitionBy("qid", "entry"))
    kept = hit.withColumn("__f", first["from_pos"]).where("from_pos = __f")
    at, size = "regexp_instr(text, __p)", "length(regexp_extract(text, __p, 0))"
    made = kept.select("qid", "entry", "to_pos", F.expr(f"concat(left(text, {at} - 1), to_term, substring(text, {at} + {size}))").alias("text"))
    one = made.groupBy("qid", "text").agg(F.min(F.struct("entry", "to_pos")).alias("o"))
    fresh = one.join(queries.select("qid", F.col("text").alias("__t")), "qid").where("text <> __t").drop("__t")
    every = fresh.unionByName(queries.select("qid", "text", F.struct(F.lit(-1).alias("entry"), F.lit(0).alias("to_pos")).alias("o")))
    numbered = every.withColumn("variant", F.row_number().over(Window.partitionBy("qid").orderBy("o", "text")) - 1)
    return numbered.where(F.col("variant") < max_variants).select("qid", "variant", "text")


def keyword_formulator(queries: DataFrame, keywords: Callable[[Column], Column]) -> DataFrame:
    """The original first, then the variants that a function of the text gives; trimmed, case-insensitively distinct."""
    texts = F.concat(F.array("text"), keywords(F.col("text")))
    rows = queries.select("qid", F.posexplode(texts).alias("__n", "__t")).select("qid", "__n", F.btrim("__t").alias("text")).where("text <> ''")
    once = rows.groupBy("qid", F.lower("text").alias("__k")).agg(F.min(F.struct("__n", "text")).alias("f"))
    return once.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("f.__n")) - 1).alias("variant"), "f.text")


def verdicts(without: DataFrame, with_: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Replay: ``(entry, ndcg)`` of both runs to ``helps``, ``no_effect``, ``hurts`` or ``unverifiable``."""
    joined = with_.select("entry", F.col("ndcg").alias("after")).join(without.select("entry", F.col("ndcg").alias("before")), "entry", "full")
    gain = F.col("after") - F.col("before")
    verdict = F.when(gain.isNull(), "unverifiable").when(gain > epsilon, "helps").when(gain < -epsilon, "hurts").otherwise("no_effect")
    status = F.when(verdict == "helps", "verified").when(verdict == "hurts", "demoted")
    return joined.select("entry", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"), verdict.alias("verdict"), status.alias("status"))
