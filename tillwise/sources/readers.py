"""Reading transactions from CSV, workbooks or Parquet, and writing result tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillwise.operators.clean import (
    coerce_transactions,
    is_online_retail,
    normalize_online_retail,
    rename_uploaded,
)
from tillwise.sources.quoted_csv import read_quoted_csv
from tillwise.sources.workbook import read_workbook


# What separates the fields of a text file, by its suffix.
SEPARATORS = {".csv": ",", ".txt": ",", ".tsv": "\t"}
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _kind(path: str) -> tuple[str, str]:
    """(csv, xlsx or parquet, separator) by the suffix, that of a compressed file being the one before."""
    stem, suffix = os.path.splitext(path.rstrip("/").lower())
    if suffix in COMPRESSED:
        suffix = os.path.splitext(stem)[1] or ".csv"
    if suffix in (".xlsx", ".xlsm"):
        return "xlsx", ","
    if suffix == ".xls":
        raise ValueError("Binary workbooks are not read; save them as .xlsx, CSV or Parquet.")
    return ("csv", SEPARATORS[suffix]) if suffix in SEPARATORS else ("parquet", ",")


def read_table(
    spark: SparkSession,
    path: str,
    kind: str | None = None,
    multi_line: bool = False,
    sheet: str | int = 0,
    file_order: bool = False,
) -> DataFrame:
    """The rows of ``path`` as stored: CSV or a workbook's ``sheet`` with every column as text, or Parquet.

    ``kind`` is csv, tsv, xlsx or parquet; without it the suffix decides (compressed files too), and
    what has none is Parquet, so name the kind of a folder of CSV files. A quote inside a
    quoted field is doubled. ``multi_line`` allows line breaks in quotes; the files are then read
    a time more, or two, to find where records begin, still in many tasks. Without it such a
    record, like any other that does not fit the header, is an error and never shifted or cut.

    ``file_order`` adds a column of that name by which rows stand as in the files: those in order
    of their paths, then the rows of each. It is for Parquet and for CSV without line breaks in
    quotes, and for operators that take an ``order_by``.

    Leaving CSV columns as text saves the extra pass over the data that inferring types takes.
    """
    found, separator = _kind(path) if kind is None else (kind, ",")
    if found == "tsv":
        found, separator = "csv", "\t"
    if file_order and (multi_line or found == "xlsx"):
        raise ValueError("The order of rows is known for Parquet, and for CSV without multi_line.")
    if found == "parquet":
        rows = spark.read.parquet(path)
        return _with_file_order(rows, F.lit(0).cast("bigint"), F.col("_metadata.row_index")) if file_order else rows
    if found == "xlsx":
        return read_workbook(spark, path, sheet)
    if found != "csv":
        raise ValueError(f"Unknown kind of table: {found}")
    if multi_line:
        return read_quoted_csv(spark, path, separator)
    # All columns are parsed even if few are used, else a bad record could go unseen.
    reader = spark.read.options(
        header=True, sep=separator, quote='"', escape='"', mode="FAILFAST", columnPruning=False
    )
    rows = reader.csv(path)
    if not file_order:
        return rows
    # Blocks of a file are read in order, and ids rise inside a task, so they rise inside a block.
    return _with_file_order(rows, F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def _with_file_order(df: DataFrame, block: Column, row: Column) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), row.alias("row"))
    return df.select("*", place.alias("file_order"))


def load_transactions(
    spark: SparkSession, path: str, date_format: str | None = None, **reading
) -> DataFrame:
    """Transactions in the standard layout, typed, with recency; ``reading``: see ``read_table``."""
    return coerce_transactions(read_table(spark, path, **reading), date_format)


def load_online_retail(
    spark: SparkSession,
    path: str,
    date_format: str | None = None,
    kind: str | None = None,
    multi_line: bool = False,
    sheet: str | int = 0,
    **options,
) -> DataFrame:
    """Transactions from the online-retail layout."""
    raw = read_table(spark, path, kind, multi_line, sheet)
    return normalize_online_retail(raw, date_format=date_format, **options)


def load_dataset(
    spark: SparkSession, path: str, date_format: str | None = None, **reading
) -> DataFrame:
    """Transactions from either layout, told apart by the column names."""
    raw = read_table(spark, path, **reading)
    if is_online_retail(raw):
        return normalize_online_retail(raw, date_format=date_format)
    return coerce_transactions(raw, date_format)


def load_uploaded(
    spark: SparkSession,
    path: str,
    date_format: str | None = None,
    rename_only: bool = False,
    **reading,
) -> DataFrame:
    """Transactions from a user's file.

    With ``rename_only`` an online-retail file is renamed and not converted, so that its
    unit price stands as ``total_spend``.
    """
    if rename_only:
        return coerce_transactions(rename_uploaded(read_table(spark, path, **reading)), date_format)
    return load_dataset(spark, path, date_format, **reading)


def write_table(
    df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()
) -> str:
    """Writes ``df`` as Parquet, or as CSV with a header, and returns the path.

    CSV fields keep their blanks; quotes in them are doubled, as ``read_table`` expects.
    """
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if kind == "csv":
        blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(header=True, quote='"', escape='"', **blanks).csv(path)
    else:
        writer.parquet(path)
    return path
