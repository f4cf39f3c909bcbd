"""Cleaning: typed columns, the online-retail layout, labels, renaming."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillwise.functions.scalars import flag, id_text, moment, named, number, real, text
from tillwise.operators.recency import ensure_recency
from tillwise.schema import (
    AMOUNT_COLUMNS,
    FLAG_COLUMNS,
    ONLINE_RETAIL_COLUMNS,
    TIME_COLUMNS,
    UPLOAD_NAMES,
)
from tillwise.session import read_again


# The shapes of dates in text that are told apart; None is ISO.
DATE_PATTERNS = (
    None,
    "M/d/yyyy H:mm",
    "d/M/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "d/M/yyyy H:mm:ss",
    "M/d/yyyy",
    "d/M/yyyy",
    "d.M.yyyy H:mm",
    "d.M.yyyy H:mm:ss",
    "d.M.yyyy",
    "yyyy/M/d H:mm",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d",
    "yyyyMMdd",
    "d-MMM-yyyy",
    "d MMM yyyy",
)


def date_shape(value: Column) -> Column:
    """Text with each run of digits as 9 and of letters as A: what a pattern can read shows in it."""
    return F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "A")


def _pattern_shape(pattern: str) -> str:
    """The only shape that a pattern of plain fields reads."""
    fields = re.sub("MMM+", "A", pattern)
    return re.sub("[yMdHms]+", "9", fields)


# What the numbers of a field can be; text beyond it is not parsed, as each failure is an exception.
FIELD_RANGES = {"M": "0*([1-9]|1[0-2])", "d": "0*([1-9]|[12][0-9]|3[01])"}


def _may_fit(pattern: str) -> str:
    """A regular expression for all texts that a pattern of plain numbers reads, and some more."""
    return "\\A" + re.sub("[A-Za-z]+", lambda field: FIELD_RANGES.get(field[0], "[0-9]+"), pattern) + "\\z"


@dataclass(frozen=True)
class DateReading:
    """How a text column of dates is read: its pattern, and how many values it reads or not."""

    pattern: str | None
    read: int
    unread: int


def date_readings(df: DataFrame, names: Sequence[str], date_format: str | None = None) -> dict[str, DateReading]:
    """The pattern of each text column of dates, by one aggregation over all rows.

    A value is only parsed by patterns of its own shape, so by three of them at most. The
    pattern that reads most values is taken. Where two shapes read equally many, as with
    days and months up to 12, and where a column that is not empty reads to nothing, it is an
    error: name the ``date_format``. Columns of other types need no pattern.
    """
    texts = [c for c in names if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return {}
    patterns = DATE_PATTERNS if date_format is None else (date_format,)
    shaped = df.select(*[named(c) for c in texts], *[date_shape(named(c)).alias(f"_shape{k}") for k, c in enumerate(texts)])
    there = [F.count_if(F.trim(named(c)) != "") for c in texts]

    def reading(k: int, pattern: str | None) -> Column:
        parsed = moment(df, texts[k], pattern)
        if date_format is not None or pattern is None:
            return F.count(parsed)
        fits = F.col(f"_shape{k}") == _pattern_shape(pattern)
        if "/" in pattern:
            # Days and months may be the other way round.
            fits &= named(texts[k]).rlike(_may_fit(pattern))
        return F.count(F.when(fits, parsed))

    reads = [reading(k, p) for k in range(len(texts)) for p in patterns]
    row = shaped.agg(*there, *reads).first()
    found = {}
    for k, c in enumerate(texts):
        counts = row[len(texts) + k * len(patterns) :][: len(patterns)]
        most = max(counts)
        if row[k] and not most:
            raise ValueError(f"No date of column {c} could be read; name its date_format.")
        best = [p for p, n in zip(patterns, counts) if n == most]
        if most and len(best) > 1:
            raise ValueError(f"The dates of column {c} fit {best}; name the date_format.")
        found[c] = DateReading(best[0], most, row[k] - most)
    return found


def _has_text(df: DataFrame, names: Sequence[str]) -> bool:
    return any(c in df.columns and isinstance(df.schema[c].dataType, T.StringType) for c in names)


def coerce_columns(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Known columns in their types; unreadable numbers and dates are NULL, flags 0.

    Dates in text are read by the pattern of ``date_readings``, which counts what is unread;
    rows that come from joins or the like are stored for that pass and those after it.
    """
    if _has_text(df, TIME_COLUMNS):
        df = read_again(df, "raw-lines")
    readings = date_readings(df, TIME_COLUMNS, date_format)
    pattern = {c: r.pattern for c, r in readings.items()}
    typed = {c: moment(df, c, pattern.get(c)) for c in TIME_COLUMNS if c in df.columns}
    typed |= {c: flag(df, c) for c in FLAG_COLUMNS if c in df.columns}
    typed |= {c: number(df, c) for c in AMOUNT_COLUMNS if c in df.columns}
    return df.withColumns(typed) if typed else df


def coerce_transactions(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Typed columns, then the recency columns; rows without a date drop out."""
    return ensure_recency(coerce_columns(df, date_format))


def is_online_retail(df: DataFrame) -> bool:
    return set(ONLINE_RETAIL_COLUMNS) <= set(df.columns)


def drop_missing_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_returns(df: DataFrame) -> DataFrame:
    """Lines with a positive quantity and a positive price."""
    return df.where((number(df, "quantity") > 0) & (number(df, "price") > 0))


def normalize_online_retail(
    df: DataFrame,
    include_returns: bool = False,
    add_churn: bool = False,
    churn_threshold_days: int = 90,
    date_format: str | None = None,
) -> DataFrame:
    """The online-retail layout as transactions.

    These rows are purchases, so the two earlier funnel stages are 0 (``attach_funnel_counts``
    brings real counts). Dates in text take a pass of their own, so that rows that come from
    joins or the like are stored first.
    """
    if _has_text(df, ["InvoiceDate"]):
        df = read_again(df.select(*[named(c) for c in ONLINE_RETAIL_COLUMNS]), "raw-lines")
    reading = date_readings(df, ["InvoiceDate"], date_format).get("InvoiceDate")
    pattern = reading.pattern if reading else None
    out = df.select(
        text("Invoice").alias("order_id"),
        moment(df, "InvoiceDate", pattern).alias("order_date"),
        id_text(df, "Customer ID").alias("customer_id"),
        text("StockCode").alias("stock_code"),
        text("Description").alias("product"),
        number(df, "Quantity").alias("quantity"),
        number(df, "Price").alias("price"),
        text("Country").alias("location"),
    )
    out = drop_missing_keys(out, "order_date", "customer_id").withColumn(
        "total_spend",
        F.coalesce(real(out, "quantity"), F.lit(0.0)) * F.coalesce(real(out, "price"), F.lit(0.0)),
    )
    if not include_returns:
        out = drop_returns(out)
    zero = F.lit(0).cast("bigint")
    out = out.withColumns(
        {
            "visited": zero,
            "added_to_cart": zero,
            "purchased": F.lit(1).cast("bigint"),
            "discount": F.lit(0.0),
        }
    )
    out = ensure_recency(out)
    return add_churn_label(out, churn_threshold_days) if add_churn else out


def line_revenue(df: DataFrame) -> DataFrame:
    """``total_spend`` = price x quantity x (1 - discount percent)."""
    return df.withColumn(
        "total_spend",
        real(df, "price") * real(df, "quantity") * (1 - real(df, "discount") / 100),
    )


def add_churn_label(
    df: DataFrame,
    churn_threshold_days: float = 90,
    customer_col: str = "customer_id",
    recency_col: str = "recency_days",
    inclusive: bool = True,
) -> DataFrame:
    """``churn`` = 1 when recency reaches (or, not inclusive, exceeds) the threshold.

    A customer without recency gets 0. The frame is unchanged if recency is neither
    present nor derivable.
    """
    if recency_col not in df.columns:
        df = ensure_recency(df, customer_col=customer_col)
    if recency_col not in df.columns:
        return df
    days = F.coalesce(F.col(recency_col), F.lit(0.0))
    limit = F.lit(float(churn_threshold_days))
    df = df.withColumn(recency_col, number(df, recency_col))
    return df.withColumn("churn", (days >= limit if inclusive else days > limit).cast("int"))


def rename_uploaded(df: DataFrame) -> DataFrame:
    """Plain renaming of uploaded columns; the unit price becomes ``total_spend`` as it is.

    Use ``normalize_online_retail`` where quantities should count.
    """
    return df.withColumnsRenamed(UPLOAD_NAMES)
