"""Sums of short vectors over a table of any number of partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that one step of the tree adds up.
FAN_IN = 32
_SCHEMA = "part long, flat array<double>"


def partitions(df: DataFrame) -> int:
    """Partitions of a table that is read the same way again."""
    last = df.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0]
    return 0 if last is None else last + 1


def vector_sum(df: DataFrame, parts: int, of: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """Sum of ``of(batches)`` over the ``parts`` partitions of ``df``, added up in a tree.

    ``of`` gives a vector of one length, or None for a partition without rows. The driver gets
    FAN_IN vectors at most; None if there is none.
    """
    def one(batches):
        flat = of(batches)
        if flat is not None:
            yield _row(TaskContext.get().partitionId(), flat)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = sum(x.values.to_numpy() for x in table["flat"])
        return pa.Table.from_batches([_row(table["part"][0].as_py() // FAN_IN, total)])

    vectors = df.mapInArrow(one, _SCHEMA)
    while parts > FAN_IN:
        vectors = vectors.groupBy(F.floor(F.col("part") / FAN_IN).alias("lane")).applyInArrow(merge, _SCHEMA)
        parts = -(-parts // FAN_IN)
    # sorted here: a sort in Spark would work out its input twice, to find ranges first
    rows = sorted(vectors.collect(), key=lambda r: r["part"])
    return sum(np.array(r["flat"]) for r in rows) if rows else None


def _row(part: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([np.asarray(flat, float)], pa.list_(pa.float64()))],
        names=["part", "flat"])
