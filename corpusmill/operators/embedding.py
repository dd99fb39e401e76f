"""Embedders: hashed term counts as Columns, and injected models in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import tokens

DIM = 512


def bucket(term, dim: int = DIM):
    """The dimension of a term: the first 32 bits of its SHA-256, modulo ``dim`` (the same in any SQL engine)."""
    return F.pmod(F.conv(F.left(F.sha2(term, 256), F.lit(8)), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hashed(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """``(key, bucket, weight)``: the unit vector of hashed term counts, as sparse rows.

    Rows are placed by key once; counting terms, adding up buckets and the norm all stay within a key, so no
    further exchange follows. A term is hashed once per row that has it, not per occurrence.
    """
    terms = rows.select(key, text).repartition(key).select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
    counts = terms.select(key, bucket(F.col("term"), dim).alias("bucket"), "n").groupBy(key, "bucket").agg(F.sum("n").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def dense_column(sparse: DataFrame, key: str, dim: int = DIM) -> DataFrame:
    """Sparse rows to an ``ARRAY<FLOAT>`` column."""
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "weight")))
    packed = sparse.groupBy(key).agg(entries.alias("__m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0.0)).cast("float"))
    return packed.select(key, vector.alias("vector"))


def normalised(vector):
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))


def embed(rows: DataFrame, text: str, model: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 256, output: str = "vector") -> DataFrame:
    """Adds ``output`` from an injected model. ``model()`` is called once per worker task and gives the embedding function.

    Null texts get a null vector; texts go to the model in batches of ``batch_size``.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            given = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for k in range(0, len(given), batch_size):
                part = given[k : k + batch_size]
                for i, v in zip(part, np.asarray(encode([texts[i] for i in part]), np.float32)):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], schema.names)

    return rows.mapInArrow(run, schema)
