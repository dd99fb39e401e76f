"""The N best items of every group, by secondary sort and streaming.

Method: rows are sorted by group, falling score and rising identifier, and Arrow batches stream past,
emitting the first N of each group; a group is never buffered. The sort runs twice: first inside the
input's own partitions, without a shuffle, which leaves at most N rows of a group in each partition;
then hash-partitioned by group. A group with a third of all rows so moves at most N rows per input
partition, and no salt is needed.

Defined results: rows whose score is null or NaN are not ranked; -0.0 equals 0.0; a null in a group
column is a value like any other; rows that repeat an identifier within its group count once, at their
best score; a null identifier ranks after all others of its score. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.runtime import free_name


def _streamed(groups: list[int], tie: int, n: int, rank: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the first ``n`` distinct identifiers of each run of equal groups; state: one group's n identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, set()
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, bool)
            for g in groups:
                codes = pc.fill_null(batch.column(g).dictionary_encode().indices, -1).to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            key = tuple(batch.column(g)[0].as_py() for g in groups)
            new[0] = key != last
            starts = np.flatnonzero(new)
            if not new[0]:
                starts = np.concatenate([[0], starts])
            ends = np.append(starts[1:], rows)
            ids, keep, ranks = batch.column(tie), [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if new[s]:
                    taken = set()
                while s < e and len(taken) < n:
                    i = ids[s].as_py()
                    if i not in taken:
                        taken.add(i)
                        keep.append(s)
                        ranks.append(len(taken))
                    s += 1
            last = tuple(batch.column(g)[rows - 1].as_py() for g in groups)
            if keep:
                out = batch.take(pa.array(keep))
                if rank is not None:
                    out = pa.RecordBatch.from_arrays([*out.columns, pa.array(ranks, pa.int32())], [*out.schema.names, rank])
                yield out

    return run


def top_n(df: DataFrame, groups: list[str], score: str, tie: str, n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` best rows of each group with their ``rank`` (1-based); ``rank`` must be no column of ``df``."""
    if rank.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{rank!r} is a column of the input; choose another name for the rank")
    sort_key = free_name(df.columns, "__score")
    kept = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    kept = kept.withColumn(sort_key, F.when(F.col(score) == 0, F.lit(0).cast(df.schema[score].dataType)).otherwise(F.col(score)))
    order = [*(F.col(g).asc_nulls_first() for g in groups), F.col(sort_key).desc(), F.col(tie).asc_nulls_last()]
    at = [df.columns.index(g) for g in groups], df.columns.index(tie)
    local = kept.sortWithinPartitions(*order).mapInArrow(_streamed(*at, n, None), kept.schema)
    final = T.StructType([*kept.schema.fields, T.StructField(rank, T.IntegerType(), False)])
    spread = local.repartition(*(F.col(g) for g in groups)).sortWithinPartitions(*order)
    return spread.mapInArrow(_streamed(*at, n, rank), final).drop(sort_key)
