"""Market summaries: sums and counts per entity and per period."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillwise.functions.scalars import moment, named, number, time_literal, total


def sum_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum of ``value`` per ``key``, largest first; rows without a key are left out."""
    return (
        df.where(named(key).isNotNull())
        .groupBy(key)
        .agg(total(number(df, value)).alias(value))
        .orderBy(F.desc(value), key)
    )


def lines_by(df: DataFrame, key: str) -> DataFrame:
    """Number of lines per ``key``, largest first, a missing key counted as its own."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), F.asc_nulls_last(key))
    )


def top_entities(
    df: DataFrame, entity_col: str, value_col: str = "total_spend", top_n: int = 20
) -> DataFrame:
    """The ``top_n`` entities by sum of ``value_col``."""
    if entity_col not in df.columns or value_col not in df.columns:
        return df.sparkSession.createDataFrame(
            [],
            T.StructType(
                [
                    T.StructField(entity_col, T.StringType()),
                    T.StructField(value_col, T.DoubleType()),
                ]
            ),
        )
    return sum_by(df, entity_col, value_col).limit(int(top_n))


def _month_end(day: Column, unit: str, last_month: int) -> Column:
    return F.last_day(F.add_months(F.trunc(day, unit), last_month))


def _week_end(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "Sunday")


def _business_day(day: Column) -> Column:
    """Saturday and Sunday belong to the Friday before."""
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


# How a day is labelled, and the first label is stepped, for each period name.
_PERIODS = {
    "D": (lambda day: day, "interval 1 day"),
    "B": (_business_day, "interval 1 day"),
    "W": (_week_end, "interval 7 days"),
    "ME": (F.last_day, "interval 1 month"),
    "QE": (lambda day: _month_end(day, "quarter", 2), "interval 3 months"),
    "YE": (lambda day: _month_end(day, "year", 11), "interval 1 year"),
    "MS": (lambda day: F.trunc(day, "month"), "interval 1 month"),
    "QS": (lambda day: F.trunc(day, "quarter"), "interval 3 months"),
    "YS": (lambda day: F.trunc(day, "year"), "interval 1 year"),
}
# Older names of the same periods.
_PERIOD_ALIASES = {"M": "ME", "Q": "QE", "Y": "YE", "A": "YE", "W-SUN": "W"}
# Periods of a fixed length, in seconds; a number may stand before them.
_FIXED = {"D": 86_400, "h": 3_600, "H": 3_600, "min": 60, "T": 60, "s": 1, "S": 1}


def revenue_over_time(
    df: DataFrame,
    time_col: str = "order_date",
    value_col: str = "total_spend",
    freq: str = "ME",
) -> DataFrame:
    """Sum per period; periods without rows show 0. The label is a date, by default the
    period's last day.

    ``freq`` is a calendar period (D, B for business days, W, ME, QE, YE, MS, QS, YS) or a
    fixed length such as h, 15min or 2D. Fixed lengths count from the start of the first
    day, and their label is the moment they begin.

    Only one row per period leaves the aggregation, so the calendar is built from its
    result and joined back.
    """
    if time_col not in df.columns or value_col not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{time_col}` date, revenue double")
    freq = _PERIOD_ALIASES.get(freq, freq)
    if freq not in _PERIODS:
        length = re.fullmatch(r"(\d*)(D|h|H|min|T|s|S)", freq)
        if not length or length[1] and not int(length[1]):
            raise ValueError(f"Unknown period: {freq}; one of {', '.join(_PERIODS)}, or such as 2D, h, 15min")
        return _over_fixed(df, time_col, value_col, int(length[1] or 1) * _FIXED[length[2]])
    label, step = _PERIODS[freq]
    sums = (
        df.select(
            label(moment(df, time_col).cast("date")).alias(time_col),
            number(df, value_col).alias("_value"),
        )
        .where(F.col(time_col).isNotNull())
        .groupBy(time_col)
        .agg(total(F.col("_value")).alias("revenue"))
    )
    # From the first of a month steps by month never slip; the label moves to the month's end.
    by_month = "month" in step or "year" in step
    first, last = F.min(time_col), F.max(time_col)
    if by_month:
        first, last = F.trunc(first, "month"), F.trunc(last, "month")
    calendar = sums.agg(first.alias("first"), last.alias("last")).select(
        F.explode(F.sequence("first", "last", F.expr(step))).alias(time_col)
    )
    if freq == "B":
        calendar = calendar.where(F.weekday(time_col) < 5)
    if freq.endswith("E"):
        calendar = calendar.select(F.last_day(time_col).alias(time_col))
    return (
        calendar.join(sums, time_col, "left")
        .select(time_col, F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
        .orderBy(time_col)
    )


def _over_fixed(df: DataFrame, time_col: str, value_col: str, seconds: int) -> DataFrame:
    """Sums per stretch of so many seconds, from the start of the first day on."""
    rows = df.select(moment(df, time_col).alias(time_col), number(df, value_col).alias("_value"))
    rows = rows.where(F.col(time_col).isNotNull())
    first = rows.agg(F.min(time_col)).first()[0]
    if first is None:
        return df.sparkSession.createDataFrame([], f"`{time_col}` timestamp_ntz, revenue double")
    origin = time_literal(first.replace(hour=0, minute=0, second=0, microsecond=0))
    place = F.floor(F.timestamp_diff("SECOND", origin, F.col(time_col)) / seconds)
    sums = rows.groupBy(place.alias("_place")).agg(total(F.col("_value")).alias("revenue"))
    calendar = sums.agg(F.min("_place").alias("first"), F.max("_place").alias("last"))
    calendar = calendar.select(F.explode(F.sequence("first", "last")).alias("_place"))
    begin = F.timestamp_add("SECOND", F.col("_place") * seconds, origin)
    return (
        calendar.join(sums, "_place", "left")
        .select(begin.alias(time_col), F.coalesce("revenue", F.lit(0.0)).alias("revenue"))
        .orderBy(time_col)
    )


# The keys that the summaries are taken by.
REVENUE_KEYS = ("category", "product", "stock_code", "location")
LINE_KEYS = ("channel", "device", "location", "payment_method")


def market_research_summary(df: DataFrame) -> dict[str, DataFrame]:
    """Named summaries, each present when its columns are; nothing runs until one is used."""
    have = set(df.columns)
    out = {
        f"revenue_by_{key}": sum_by(df, key, "total_spend")
        for key in REVENUE_KEYS
        if {key, "total_spend"} <= have
    }
    if {"product", "quantity"} <= have:
        out["quantity_by_product"] = sum_by(df, "product", "quantity")
    for key in LINE_KEYS:
        if key in have:
            out[f"orders_by_{key}"] = lines_by(df, key)
    if {"order_date", "total_spend"} <= have:
        out["revenue_over_time_month"] = revenue_over_time(df, freq="ME")
    return out


def headline_numbers(df: DataFrame) -> DataFrame:
    """Rows, distinct customers, distinct orders and revenue, in one row.

    Lines are merged per order first: two distinct counts read their input several times
    over, and orders are far fewer than lines.
    """
    spend = number(df, "total_spend")
    keys = [c for c in ("customer_id", "order_id") if c in df.columns]
    merged = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_lines"), F.sum(spend).alias("_spend")
    )
    orders = (
        F.count_distinct("order_id") if "order_id" in keys else F.lit(None).cast("bigint")
    )
    return merged.agg(
        F.coalesce(F.sum("_lines"), F.lit(0)).alias("rows"),
        F.count_distinct("customer_id").alias("customers"),
        orders.alias("orders"),
        total(F.col("_spend")).alias("revenue"),
    )


def category_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-missing values of each column, as one row per column."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("level"))
                for c in columns
            ]
        )
    )
    return (
        df.select(pairs.alias("pair"))
        .select("pair.*")
        .where(F.col("level").isNotNull())
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("levels"))
    )
