"""Last purchase and days since, per customer; last label per customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.scalars import elapsed_days, flag, moment, named
from tillwise.operators.joins import left_join_unique
from tillwise.session import materialize


def customer_recency(
    df: DataFrame,
    customer_col: str = "customer_id",
    time_col: str = "order_date",
    purchase_col: str = "purchased",
    once: bool = False,
) -> DataFrame:
    """One row per customer: ``last_purchase_date``, ``recency_days``, ``lines``.

    Days count back from the newest row of the data. Only purchases count as last
    purchase, unless the data holds no purchase at all. One aggregation, then a one-row
    summary of it, for which it is stored; with ``once`` nothing is stored and nothing runs yet.
    """
    when = moment(df, time_col)
    bought = when
    if purchase_col in df.columns:
        bought = F.when(flag(df, purchase_col) == 1, when)
    per_customer = (
        df.where(when.isNotNull())
        .groupBy(customer_col)
        .agg(
            F.max(when).alias("_last_row"),
            F.max(bought).alias("_last_bought"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    if not once:
        per_customer = materialize(per_customer, "last-rows")
    newest = per_customer.agg(F.max("_last_row")).scalar()
    newest_bought = per_customer.agg(F.max("_last_bought")).scalar()
    last = F.when(newest_bought.isNull(), F.col("_last_row")).otherwise(F.col("_last_bought"))
    return (
        per_customer.where(F.col(customer_col).isNotNull())
        .withColumn("last_purchase_date", last)
        .select(
            customer_col,
            "last_purchase_date",
            elapsed_days(newest, F.col("last_purchase_date")).cast("double").alias("recency_days"),
            "lines",
        )
    )


def dated_lines(df: DataFrame, time_col: str = "order_date", purchase_col: str = "purchased") -> DataFrame:
    """Lines with a date, as a moment, and their purchase column as a whole number."""
    df = df.withColumn(time_col, moment(df, time_col)).where(F.col(time_col).isNotNull())
    if purchase_col in df.columns:
        df = df.withColumn(purchase_col, flag(df, purchase_col))
    return df


def ensure_recency(
    df: DataFrame,
    customer_col: str = "customer_id",
    time_col: str = "order_date",
    purchase_col: str = "purchased",
) -> DataFrame:
    """Lines with a date, with ``last_purchase_date`` and ``recency_days`` where absent."""
    if customer_col not in df.columns or time_col not in df.columns:
        return df
    df = dated_lines(df, time_col, purchase_col)
    missing = [c for c in ("last_purchase_date", "recency_days") if c not in df.columns]
    if not missing:
        return df
    summary = customer_recency(df, customer_col, time_col, purchase_col)
    return left_join_unique(
        df,
        summary.select(customer_col, *missing, "lines"),
        customer_col,
        rows_per_key="lines",
        slot_by=[time_col],
    )


def purchased_rows(df: DataFrame, purchase_col: str = "purchased") -> DataFrame:
    """Purchase lines, or every line when the data holds no purchase."""
    if purchase_col not in df.columns:
        return df
    is_purchase = flag(df, purchase_col) == 1
    any_purchase = df.agg(F.coalesce(F.bool_or(is_purchase), F.lit(False))).scalar()
    return df.where(is_purchase | ~any_purchase)


def latest_customer_label(
    df: DataFrame,
    label_col: str = "churn",
    customer_col: str = "customer_id",
    time_col: str = "order_date",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The label on each customer's last row; a row without a date counts as the last.

    Rows of one moment are ordered by ``order_by``, then by the label. Without the time
    column ``order_by`` is required, since a distributed table has no row order of its own.
    The maximum is merged before the shuffle, so a customer with many rows is no burden.
    """
    for column in (customer_col, label_col):
        if column not in df.columns:
            raise ValueError(f"Missing column: {column}")
    order = [named(c) for c in order_by]
    if time_col in df.columns:
        when = moment(df, time_col)
        order = [when.isNull(), when, *order]
    elif not order:
        raise ValueError(f"Missing column: {time_col}; name the row order with order_by")
    label = named(label_col)
    return (
        df.where(F.col(customer_col).isNotNull())
        .groupBy(customer_col)
        .agg(F.max_by(label, F.struct(*order, label)).alias(label_col))
    )
