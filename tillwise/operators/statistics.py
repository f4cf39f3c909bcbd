"""Sums over all rows of a table of points, taken in one pass: what model fits are made from."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, functions as F

#: Up to so many partial sums are added up by the driver; more are added up in a shuffle first.
FEW_TASKS = 64

Batch = dict[str, np.ndarray]


def matrix(column: pa.Array) -> np.ndarray:
    """A column; one of arrays, all as long, becomes a matrix."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values = column.flatten().to_numpy(zero_copy_only=False)
        return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


def arrays(batch: pa.RecordBatch) -> Batch:
    """A batch's columns, those of arrays as matrices."""
    return {name: matrix(batch.column(name)) for name in batch.schema.names}


def summed(points: DataFrame | RDD, partial: Callable[[Batch], np.ndarray], tasks: int) -> np.ndarray | None:
    """The sum of ``partial`` over all batches of ``points``, a table or batches; None without rows.

    ``partial`` turns a batch into a flat vector, whose length must not depend on the batch.
    Each task adds up its own batches, so what is moved is one vector per task; ``tasks`` is the
    most partitions that ``points`` has.
    """

    def total_of(batches: Iterable[Batch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            mine = np.asarray(partial(batch), float).ravel()
            total = mine if total is None else total + mine
        return total

    if isinstance(points, RDD):
        each = points.mapPartitions(lambda batches: [total_of(batches)]).filter(lambda total: total is not None)
        rows = each.collect() if tasks <= FEW_TASKS else [each.treeReduce(np.add)]
        return np.sum(rows, axis=0) if rows else None

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = total_of(arrays(batch) for batch in batches if batch.num_rows)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["total"])

    totals = points.mapInArrow(add_up, "total array<double>")
    if tasks <= FEW_TASKS:
        rows = [r.total for r in totals.collect()]
        return np.sum(rows, axis=0) if rows else None
    sums = totals.select(F.posexplode("total").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return None
    out = np.zeros(len(sums))
    for r in sums:
        out[r.i] = r.v
    return out
