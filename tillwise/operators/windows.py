"""Time windows over the transactions, and bounded samples of them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.scalars import flag, moment, time_literal
from tillwise.session import materialize, read_again

# The selectable windows in days.
WINDOW_DAYS = {"last_30d": 30, "last_90d": 90, "last_180d": 180}


def max_time(df: DataFrame, time_col: str = "order_date") -> datetime | None:
    """Newest moment of the data, as a value: later filters on it then reach the file scan."""
    return df.agg(F.max(moment(df, time_col))).first()[0]


def filter_time_window(
    df: DataFrame,
    window: str = "all",
    time_col: str = "order_date",
    newest: datetime | None = None,
) -> DataFrame:
    """Rows of the last days before the newest row; pass ``newest`` if it is known."""
    if window == "all" or time_col not in df.columns:
        return df
    if newest is None:
        newest = max_time(df, time_col)
    if newest is None:
        return df
    cutoff = newest - timedelta(days=WINDOW_DAYS[window])
    return df.where(moment(df, time_col) >= time_literal(cutoff))


def history(
    df: DataFrame,
    as_of: datetime,
    lookback_days: int | None = 180,
    time_col: str = "order_date",
) -> DataFrame:
    """Rows up to ``as_of``, from ``lookback_days`` before it; both ends belong to it."""
    when = moment(df, time_col)
    df = df.where(when <= time_literal(as_of))
    if lookback_days is None:
        return df
    return df.where(when >= time_literal(as_of - timedelta(days=int(lookback_days))))


def future_purchases(
    df: DataFrame,
    as_of: datetime,
    horizon_days: int = 90,
    time_col: str = "order_date",
    purchase_col: str = "purchased",
) -> DataFrame:
    """Purchases after ``as_of`` up to and including the end of the horizon."""
    when = moment(df, time_col)
    end = as_of + timedelta(days=int(horizon_days))
    ahead = df.where((when > time_literal(as_of)) & (when <= time_literal(end)))
    if purchase_col in df.columns:
        ahead = ahead.where(flag(df, purchase_col) == 1)
    return ahead


def recent(
    df: DataFrame,
    as_of: datetime,
    lookback_days: int | None = 180,
    time_col: str = "order_date",
) -> DataFrame:
    """Rows from ``lookback_days`` before ``as_of`` on, stored if they come from joins or the like.

    ``history`` and ``future_purchases`` at ``as_of`` or later find all their rows in it.
    """
    if lookback_days is not None:
        df = df.where(moment(df, time_col) >= time_literal(as_of - timedelta(days=int(lookback_days))))
    return read_again(df, "recent")


def choose_as_of(df: DataFrame, horizon_days: int = 90, time_col: str = "order_date") -> datetime:
    """The newest moment that still leaves a full horizon of data after it."""
    if time_col not in df.columns:
        raise ValueError(f"Missing column: {time_col}")
    newest = max_time(df, time_col)
    if newest is None:
        raise ValueError("No valid timestamps found.")
    return newest - timedelta(days=int(horizon_days))


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; these are stored first, so Spark knows their size when it joins."""
    return df.join(materialize(ids, "kept-ids"), key, "left_semi")


def sample_customers(
    df: DataFrame, limit: int = 1000, seed: int = 42, customer_col: str = "customer_id"
) -> DataFrame:
    """All rows of ``limit`` customers, chosen by a seeded hash of the id.

    A table of at most ``limit`` customers keeps every row.
    """
    if customer_col not in df.columns:
        return df
    ids = df.where(F.col(customer_col).isNotNull()).select(customer_col).distinct()
    if ids.limit(limit + 1).count() <= limit:
        return df
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(customer_col).cast("string")))
    return keep_ids(df, ids.orderBy(draw, customer_col).limit(limit), customer_col)


def preview(df: DataFrame, order_by: list[str], limit: int = 1000) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order_by).limit(limit)
