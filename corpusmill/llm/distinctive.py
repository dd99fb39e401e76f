"""How distinctive a term is for a record: residual inverse document frequency times term frequency.

With N records, a term in ``df`` of them and ``cf`` occurrences in all, the observed inverse document
frequency is log2(N / df). If the occurrences fell at random (Poisson), a record would hold the term with
probability 1 - exp(-cf / N). The residual, log2(N / df) - log2(1 / (1 - exp(-cf / N))), is the part of
the rarity that chance does not explain: it is high for terms concentrated in few records. The score is
the residual times the frequency in the record.

Plan: records are made unique, tokenised once per pass in Arrow batches that already hold (term,
frequency) per record, and the term statistics are a partial aggregate, so a term in a third of all
records is combined before the shuffle. Postings meet the statistics by a join in which terms with more
than a thousandth of all postings (at most a thousand terms) are answered by a bounded broadcast.

Defined results: terms are the longest runs of letters, digits and underscores of the lower-cased text;
null and blank texts have no terms but count as records; repeated rows of a record count once (the
latest by ``order_by``, else any); ties in the score order by term.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.skew import HEAVY_PARTS

TERM = re.compile(r"\w+")


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``: one row per record and term, made where the record lies."""

    def run(batches):
        find = TERM.findall
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                rows, terms, counts = [], [], []
                for r, t in enumerate(texts[at : at + 512], at):
                    if t:
                        c = Counter(find(t.lower()))
                        rows += [r] * len(c)
                        terms += c
                        counts += c.values()
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(terms, pa.string()), pa.array(counts, pa.int32())], [key, "term", "tf"])

    schema = T.StructType([df.schema[key], T.StructField("term", T.StringType(), False), T.StructField("tf", T.IntegerType(), False)])
    return df.select(key, text).mapInArrow(run, schema)


def unique_records(df: DataFrame, key: str, text: str, order_by: str | None) -> DataFrame:
    """One row per key, the latest; rows without a key are no records."""
    seen = df.where(F.col(key).isNotNull())
    if order_by is None:
        return seen.groupBy(key).agg(F.max(text).alias(text))
    return seen.groupBy(key).agg(F.max(F.struct(F.col(order_by), F.col(text))).alias("__b")).select(key, F.col(f"__b.{text}").alias(text))


def residual_idf(df, cf, n):
    """The residual as a column expression of document frequency, collection frequency and record count."""
    return -F.log2(df / n) + F.log2(-F.expm1(-cf / n))


def distinctive_terms(records: DataFrame, key: str = "record_id", text: str = "text", order_by: str | None = "ingested_at") -> DataFrame:
    """``(key, term, tf, df, cf, ridf, score)`` for every record and each of its terms."""
    unique = unique_records(records, key, text, order_by)
    postings = term_frequencies(unique, key, text)
    stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    # one row: the number of records, and of postings for the bound on heavy terms
    n = records.agg(F.count_distinct(key).alias("n"))
    total = stats.agg(F.sum("df").alias("postings"))
    stats = stats.crossJoin(F.broadcast(n.crossJoin(total)))
    ridf = residual_idf(F.col("df").cast("double"), F.col("cf").cast("double"), F.col("n").cast("double"))
    heavy = F.col("df") * HEAVY_PARTS > F.col("postings")
    stats = stats.select("term", "df", "cf", ridf.alias("ridf"), heavy.alias("heavy"))
    hot = stats.where("heavy").drop("heavy")
    # heavy terms: fewer than HEAVY_PARTS rows, since their frequencies add up to the postings at most
    common = postings.join(F.broadcast(hot), "term")
    rest = postings.join(F.broadcast(hot.select("term")), "term", "left_anti").join(stats.where("NOT heavy").drop("heavy"), "term")
    both = common.unionByName(rest)
    return both.select(key, "term", "tf", "df", "cf", "ridf", (F.col("tf") * F.col("ridf")).alias("score"))
