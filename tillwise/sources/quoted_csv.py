"""CSV whose quoted fields may hold line breaks, read by many tasks per file.

Where a line begins a record depends on the quotes of all lines before it: a line break is
inside a field if their number is odd. So quotes are counted per block of a file first, which
gives each block the parity it begins with. Then every block cuts its own lines into records.
What lies at a block's ends, the begin of its last record and the rest of one that an earlier
block began, is put together afterwards; that is at most two pieces per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tillwise.session import materialize

QUOTE = '"'
#: Kinds of pieces; a header that goes over its block begins like a record that doesn't count.
WHOLE, HEADER, BEGUN, REST, CLOSED = range(5)
PIECES = "block long, kind int, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): physical lines, without their line feed, and their block."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )


def _block(file: str = "file", start: str = "start"):
    return F.xxhash64(file, start)


def _blocks(lines: DataFrame) -> DataFrame:
    """(block, file, start, odd): whether an odd number of quotes lies before the block in its file."""
    quotes = F.length("value") - F.length(F.translate("value", QUOTE, ""))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    # One row per block of a file.
    counts = materialize(counts.withColumn("block", _block()), "blocks")
    whole = Window.partitionBy("file")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "block", "file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("odd"),
        (F.sum("quotes").over(whole) % 2 == 1).alias("unbalanced"),
    )


class _Cutter:
    """A task's work: its lines to records.

    ``known`` holds the blocks, sorted, and ``odd`` which of them begin inside a field.
    """

    def __init__(self, known: np.ndarray, odd: np.ndarray):
        self.known, self.odd = known, odd

    def begins_inside(self, block: int) -> bool:
        at = int(np.searchsorted(self.known, block))
        if at == len(self.known) or int(self.known[at]) != block:
            raise RuntimeError("The files are cut into other blocks than before; set spark.sql.files.minPartitionNum.")
        return bool(self.odd[at])

    def open(self, block: int, is_first: bool) -> None:
        self.block = block
        # Lines of the record that is not complete yet, and whether an earlier block began it.
        self.held: list[str] = []
        self.inside = self.headless = self.begins_inside(block)
        self.header = is_first
        self.rows: list[tuple] = []

    def give(self, kind: int, text: str) -> None:
        if kind in (WHOLE, BEGUN) and self.header and text.strip("\r\ufeff"):
            # The header may itself go over the end of its block; what follows is told by its kind.
            self.header = False
            if kind == WHOLE:
                return
            kind = HEADER
        self.rows.append((self.block, kind, text))

    def close(self) -> None:
        if self.inside:
            self.give(REST if self.headless else BEGUN, "\n".join(self.held))

    def add(self, values: pa.Array) -> None:
        odd = pc.count_substring(values, QUOTE).to_numpy() % 2 == 1
        lines = values.to_pylist()
        if not self.inside and not self.header and not odd.any():
            self.rows += [(self.block, WHOLE, line) for line in lines]
            return
        for line, is_odd in zip(lines, odd.tolist()):
            if not self.inside and not is_odd:
                self.give(WHOLE, line)
                continue
            self.held.append(line)
            self.inside ^= is_odd
            if not self.inside:
                self.give(CLOSED if self.headless else WHOLE, "\n".join(self.held))
                self.held, self.headless = [], False

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.block: int | None = None
        self.rows = []
        for batch in batches:
            blocks, firsts = batch.column("block").to_numpy(), batch.column("is_first").to_pylist()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if a < b and int(blocks[a]) != self.block:
                    if self.block is not None:
                        self.close()
                        yield _piece_batch(self.rows)
                    self.open(int(blocks[a]), firsts[a])
                if a < b:
                    self.add(batch.column("value").slice(a, b - a))
            yield _piece_batch(self.rows)
            self.rows = []
        if self.block is not None:
            self.close()
        yield _piece_batch(self.rows)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[], [], []], kinds)], names=["block", "kind", "text"])


def _joined(ends: DataFrame, blocks: DataFrame) -> DataFrame:
    """(text): records that go over the end of a block, from their pieces in order."""
    placed = ends.join(blocks.select("block", "file", "start"), "block")
    # Inside a block the rest of an older record comes before the begin of a new one.
    order = Window.partitionBy("file").orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("record", F.count_if(F.col("kind").isin(BEGUN, HEADER)).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("start", "text")))
    grouped = numbered.groupBy("file", "record").agg(pieces.alias("pieces"), F.min("kind").alias("kind"))
    return grouped.where(F.col("kind") != HEADER).select(F.array_join(F.col("pieces.text"), "\n").alias("text"))


def header_of(spark: SparkSession, path: str, separator: str) -> list[str]:
    """The column names, from the first record of the first file."""
    options = {"header": True, "sep": separator, "quote": QUOTE, "escape": QUOTE, "multiLine": True}
    return spark.read.options(**options).csv(path).columns


def read_quoted_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The records of CSV files with a header each, all columns as text.

    Fields in quotes may hold separators, line breaks and doubled quotes. Files are read in
    blocks by as many tasks as their size deserves. Lines end in a line feed, or carriage
    return and line feed; empty lines between records don't count. A quote that is never closed
    is an error, as is a record that does not fit the header.
    """
    columns = header_of(spark, path, separator)
    lines = _lines(spark, path)
    blocks = materialize(_blocks(lines), "parities")
    known, distinct = blocks.agg(F.count("*"), F.count_distinct("block")).first()
    if known != distinct:
        raise ValueError("Two blocks share a hash; read fewer files at once.")
    wrong = blocks.where("unbalanced").select("file").distinct().take(3)
    if wrong:
        raise ValueError(f"A quote is not closed in {[r.file for r in wrong]}.")
    # A number and a flag for each block: 9 bytes per block, that is per 128 MB of the files.
    rows = sorted((r.block, r.odd) for r in blocks.select("block", "odd").collect())
    cutter = _Cutter(np.array([b for b, _ in rows], np.int64), np.array([o for _, o in rows], bool))
    pieces = lines.select(_block().alias("block"), (F.col("start") == 0).alias("is_first"), "value").mapInArrow(cutter, PIECES)
    text = pieces.where(F.col("kind") == WHOLE).select("text")
    if any(o for _, o in rows):
        # The ends of blocks are found in a pass of their own, so that the files are not copied.
        ends = materialize(pieces.where(F.col("kind") != WHOLE), "ends")
        text = text.union(_joined(ends, blocks))
    options = {"sep": separator, "quote": QUOTE, "escape": QUOTE, "mode": "FAILFAST"}
    record = text.select(F.regexp_replace("text", "\\r\\z", "").alias("text")).where("text <> ''")
    parsed = record.select(F.from_csv("text", ", ".join(f"c{k} string" for k in range(len(columns))), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(c) for k, c in enumerate(columns)])
