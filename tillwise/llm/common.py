"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.session import materialize

# The bytes that end a word, and A-Z mapped to a-z.
SPACES = "[^\\x20\\x09-\\x0D]+"
LOWER = bytes(range(256)).lower()
#: Bytes of a batch of rows that goes to Python; a single larger row is a batch of its own.
BATCH_BYTES = 32 << 20


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def draw(*columns: str) -> Column:
    """A row's hash, from 0 to 2^62 - 1."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def drawn(share: float, *columns: str) -> Column:
    """True for about ``share`` of all rows, by their hash; fine enough for any number of rows."""
    return draw(*columns) < F.lit(min(1 << 62, max(1, int(share * (1 << 62)))))


def set_aside(df: DataFrame, *kept: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with all columns but ``kept`` under plain names that clash with none, and what names them back.

    The latter takes a frame made of the first and the names of new columns to keep.
    """
    names = [c if c in kept else f"_aside{k}" for k, c in enumerate(df.columns)]
    back = lambda out, *new: out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)], *new)
    return df.toDF(*names), back


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a text column, one value at a time; b"" for null."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py() or b""


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for the batches of a task, after which unused memory goes back to the system.

    Python workers outlive their tasks, and what allocators keep for later would add up over
    the stages of a job.
    """

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def small_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """``df`` whose rows are to go to Python; from now on in batches of ``rows`` and ``BATCH_BYTES`` at most.

    A worker holds a batch and what it makes of it at once, so with whole texts the usual ten
    thousand rows take more memory than the work does.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def running_totals(df: DataFrame, order: list[Column], name: str, **values: Column) -> DataFrame:
    """``df`` with, per value, the sum over all rows before it in ``order``.

    Rows are dealt out by ranges of ``order`` and summed inside each range; what lies before
    a range comes from one row per range. No task sees more than one range, however the rows
    are spread over keys. ``order`` must be a total order for a defined result.
    """
    dealt = df.withColumns(values).repartitionByRange(*order)
    placed = materialize(dealt.withColumn("_range", F.spark_partition_id()), name)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    # One row per range: as many as Spark has partitions, whatever the size of the data.
    offsets = ranges.select(
        "_range", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values]
    )
    local = placed.withColumns({v: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = local.join(F.broadcast(offsets), "_range")
    return joined.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop(
        "_range", *[f"_{v}" for v in values]
    )
