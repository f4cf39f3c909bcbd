"""One row per customer: order, funnel, money, recency and category-share features."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillwise.functions.scalars import (
    elapsed_days,
    flag,
    log1p_or_zero,
    moment,
    named,
    number,
    real,
    safe_divide,
    time_literal,
)
from tillwise.operators.windows import history
from tillwise.schema import CATEGORY_COLUMNS, DEFAULTED_COLUMNS
from tillwise.session import materialize, read_again

Levels = Mapping[str, Sequence[object]]
Merge = Callable[[str], Column]
LINE_COLUMNS = (
    "order_date", "total_spend", "price", "quantity", "discount", "visited", "added_to_cart", "purchased", "recency_days",
)
# A table of more columns than this per category is no longer a table to work with.
WIDE = 1000
# Lines are counted into one counter per level at once up to so many of them, else per level first.
COUNTERS = 300


def customer_features(
    df: DataFrame,
    customer_col: str = "customer_id",
    order_col: str = "order_id",
    max_category_levels: int | None = None,
    levels: Levels | None = None,
    since_purchase: bool = False,
    once: bool = False,
) -> DataFrame:
    """Features over the whole table.

    Missing discounts count as 0. Recency is the smallest ``recency_days`` of the customer
    or, without that column, the days from the customer's newest row to the newest of all.
    The lines are read for the orders, for the names of the category levels and for their shares;
    lines that come from joins or the like are stored first.

    With ``since_purchase`` lines without ``recency_days`` get what ``ensure_recency`` would give
    them: the days since the customer's last purchase, or last row if nothing was ever bought.
    ``once`` is for a caller that stores the result: the shares are then not stored by themselves.

    Every level of a category column becomes a share column. ``levels`` names them instead;
    ``max_category_levels`` leaves out columns with more levels and warns of each. Without
    either a column of more than ``WIDE`` levels is an error: its shares are for
    ``category_shares_long``.
    """
    if customer_col not in df.columns:
        raise ValueError(f"Missing column: {customer_col}")
    df = _used(df, customer_col, order_col, levels)
    zero = F.lit(0.0)
    revenue = zero
    if "total_spend" in df.columns:
        revenue = number(df, "total_spend")
    elif {"price", "quantity"} <= set(df.columns):
        revenue = F.coalesce(real(df, "price"), zero) * F.coalesce(real(df, "quantity"), zero)
    discount = F.coalesce(real(df, "discount"), zero) if "discount" in df.columns else None

    base = _order_features(df, customer_col, order_col, revenue, discount)
    if "recency_days" in df.columns:
        recency = F.col("_recency")
    elif "order_date" in df.columns:
        newest = base.agg(F.max("_last")).scalar()
        last = F.col("_last")
        if since_purchase and "purchased" in df.columns:
            newest_bought = base.agg(F.max("_last_bought")).scalar()
            last = F.when(newest_bought.isNull(), last).otherwise(F.col("_last_bought"))
        recency = elapsed_days(newest, last)
    else:
        recency = F.lit(None)
    base = base.withColumn("recency_days", recency.cast("double")).select(
        customer_col,
        "orders",
        "visits",
        "added_to_cart",
        "purchases",
        "revenue_total",
        "avg_order_value",
        "avg_discount",
        "recency_days",
    )
    return _finish(df, base, customer_col, max_category_levels, levels, once)


def customer_features_asof(
    df: DataFrame,
    as_of: datetime,
    lookback_days: int | None = 180,
    customer_col: str = "customer_id",
    max_category_levels: int | None = None,
    levels: Levels | None = None,
    once: bool = False,
) -> DataFrame:
    """Features from the history up to ``as_of`` only, so that nothing later leaks in.

    Recency is measured from the last *purchase*; a customer without one gets a day more
    than the lookback. ``lookback_days=None`` uses all history; the stand-in is then a day
    more than the age of its first row. ``once`` is that of ``customer_features``.
    """
    if "order_date" not in df.columns:
        raise ValueError("Missing column: order_date")
    df = df.withColumn("order_date", moment(df, "order_date"))
    df = _used(history(df, as_of, lookback_days), customer_col, "order_id", levels)
    revenue = number(df, "total_spend") if "total_spend" in df.columns else F.lit(0.0)
    discount = real(df, "discount") if "discount" in df.columns else None

    base = _order_features(df, customer_col, "order_id", revenue, discount)
    now = time_literal(as_of)
    if lookback_days is None:
        first = base.agg(F.min("_first")).scalar()
        stand_in = elapsed_days(now, first) + 1
    else:
        stand_in = F.lit(int(lookback_days) + 1)
    last = F.col("_last_bought" if "purchased" in df.columns else "_last")
    recency = F.coalesce(elapsed_days(now, last), stand_in)
    base = base.withColumn("recency_days", recency.cast("double")).select(
        customer_col,
        "orders",
        "visits",
        "added_to_cart",
        "purchases",
        "revenue_total",
        "avg_discount",
        "avg_order_value",
        "recency_days",
    )
    return _finish(df, base, customer_col, max_category_levels, levels, once)


def _used(df: DataFrame, customer_col: str, order_col: str, levels: Levels | None) -> DataFrame:
    """The columns that features are made of, for two passes."""
    categories = CATEGORY_COLUMNS if levels is None else tuple(levels)
    wanted = {customer_col, order_col, *LINE_COLUMNS, *categories}
    return read_again(df.select(*[named(c) for c in df.columns if c in wanted]), "feature-lines")


def _order_features(
    df: DataFrame,
    customer_col: str,
    order_col: str,
    revenue: Column,
    discount: Column | None,
) -> DataFrame:
    """Order, funnel and money features per customer, and what recency is made from.

    Lines are first merged per (customer, order), then per customer. Distinct orders become
    a plain count, and both steps merge before they shuffle, so neither a customer nor an
    order with very many lines lands in one task.
    """
    have = set(df.columns)
    has_orders = order_col in have
    one = F.lit(1).cast("bigint")
    # Name: value on a line, merge within an order, merge of orders. A name that does not
    # occur below is not computed.
    parts: dict[str, tuple[Column, Merge, Merge]] = {
        "_revenue": (revenue, F.sum, F.sum),
    }
    if "visited" in have:
        parts["_visits"] = (real(df, "visited"), F.sum, F.sum)
    if "added_to_cart" in have:
        parts["_carts"] = (real(df, "added_to_cart"), F.sum, F.sum)
    if discount is not None:
        parts["_discount"] = (discount, F.sum, F.sum)
        parts["_discounts"] = (discount, F.count, F.sum)
    if "recency_days" in have:
        parts["_recency"] = (real(df, "recency_days"), F.min, F.min)
    bought = F.when(flag(df, "purchased") == 1, one) if "purchased" in have else one
    if "order_date" in have:
        when = moment(df, "order_date")
        parts["_last"] = (when, F.max, F.max)
        parts["_first"] = (when, F.min, F.min)
        if "purchased" in have:
            parts["_last_bought"] = (F.when(bought == 1, when), F.max, F.max)
    if has_orders:
        # An order counts as bought when any of its lines is; lines without an order do not.
        counted = F.when(named(order_col).isNotNull(), one)
        parts["_orders"] = (counted, F.max, F.sum)
        parts["_purchases"] = (F.when(counted == 1, bought), F.max, F.sum)
    else:
        parts["_orders"] = (one, F.sum, F.sum)
        parts["_purchases"] = (bought, F.sum, F.sum)

    # Lines without a customer count for the newest and first date only.
    keys = [customer_col, order_col] if has_orders else [customer_col]
    per_order = (
        df.select(*[named(k) for k in keys], *[p[0].alias(n) for n, p in parts.items()])
        .groupBy(*keys)
        .agg(*[p[1](n).alias(n) for n, p in parts.items()])
    )
    per_customer = per_order
    if has_orders:
        per_customer = per_order.groupBy(customer_col).agg(
            *[p[2](n).alias(n) for n, p in parts.items()]
        )
    per_customer = materialize(per_customer, "per-customer")

    def amount(name: str) -> Column:
        if name not in parts:
            return F.lit(0.0)
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    orders, money = amount("_orders"), amount("_revenue")
    return per_customer.withColumns(
        {
            "orders": orders,
            "visits": amount("_visits") if "visited" in have else orders,
            "added_to_cart": amount("_carts"),
            "purchases": amount("_purchases"),
            "revenue_total": money,
            "avg_order_value": safe_divide(money, orders),
            "avg_discount": safe_divide(amount("_discount"), amount("_discounts")),
        }
    )


def _finish(
    df: DataFrame,
    base: DataFrame,
    customer_col: str,
    max_category_levels: int | None,
    levels: Levels | None,
    once: bool,
) -> DataFrame:
    """Adds rates, category shares and logarithms; no feature is left missing."""
    visits, carts, bought = F.col("visits"), F.col("added_to_cart"), F.col("purchases")
    out = base.where(named(customer_col).isNotNull()).withColumns(
        {
            "recency_days": F.coalesce("recency_days", F.lit(0.0)),
            "cart_rate": safe_divide(carts, visits),
            "purchase_rate": safe_divide(bought, visits),
            "cart_to_purchase_rate": safe_divide(bought, carts),
        }
    )
    columns = CATEGORY_COLUMNS if levels is None else tuple(levels)
    present = [c for c in columns if c in df.columns]
    if present:
        if levels is None:
            levels = category_levels(df, max_category_levels, present)
        shares = category_shares(df, levels, customer_col)
        shares = shares if once else materialize(shares, "levels")
        added = [c for c in shares.columns if c != customer_col]
        if added:
            out = out.join(shares, customer_col, "left")
            out = out.withColumns({c: F.coalesce(named(c), F.lit(0.0)) for c in added})
    return out.withColumns(
        {
            "revenue_total_log1p": log1p_or_zero(F.col("revenue_total")),
            "avg_order_value_log1p": log1p_or_zero(F.col("avg_order_value")),
        }
    )


def level_counts(
    df: DataFrame, customer_col: str = "customer_id", columns: Sequence[str] = CATEGORY_COLUMNS
) -> DataFrame:
    """Lines per customer, category column and level (as text): ``column``, ``level``, ``lines``.

    One aggregation that merges before it shuffles; NULL is no level. Customers without an
    identity count under NULL, so that their levels exist too.
    """
    present = [c for c in columns if c in df.columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("level")) for c in present]))
    rows = df.select(named(customer_col), each.alias("_x")).select(customer_col, "_x.column", "_x.level")
    return rows.where(F.col("level").isNotNull()).groupBy(customer_col, "column", "level").agg(F.count(F.lit(1)).alias("lines"))


def distinct_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The levels (as text) of each of ``columns``: ``column``, ``level``; NULL is no level.

    Each column is read by itself, so what is merged before the shuffle is as small as its levels.
    """
    each = [df.select(F.lit(c).alias("column"), named(c).cast("string").alias("level")) for c in columns]
    return reduce(DataFrame.unionAll, [rows.where(F.col("level").isNotNull()).distinct() for rows in each])


def category_levels(
    df: DataFrame, max_levels: int | None = None, columns: Sequence[str] = CATEGORY_COLUMNS
) -> dict[str, list]:
    """Levels of the category columns of ``df`` in the order of their type.

    With ``max_levels`` a column of more levels is left out, with a warning; without, one of
    more than ``WIDE`` is an error. Only levels of columns within the limit are collected.
    """
    kinds = {c: df.schema[c].dataType for c in columns if c in df.columns}
    if not kinds:
        return {}
    limit = WIDE if max_levels is None else max_levels
    lines = read_again(df.select(*[named(c) for c in kinds]), "level-lines")
    distinct = materialize(distinct_levels(lines, list(kinds)), "distinct-levels")
    sizes = {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
    wide = [c for c in kinds if sizes.get(c, 0) > limit]
    if wide and max_levels is None:
        raise ValueError(
            f"More than {WIDE} levels in {wide}: use category_shares_long, levels or max_category_levels."
        )
    for c in wide:
        warnings.warn(f"No shares of column {c}: {sizes[c]} levels, the limit is {limit}.", stacklevel=2)
    kept = distinct.where(F.col("column").isin([c for c in kinds if c not in wide])).collect()
    levels = {}
    for c, kind in kinds.items():
        if c not in wide:
            texts = [r["level"] for r in kept if r["column"] == c]
            levels[c] = sorted(int(t) for t in texts) if isinstance(kind, T.IntegralType) else sorted(texts)
    return levels


def category_shares_long(
    df: DataFrame, customer_col: str = "customer_id", columns: Sequence[str] = CATEGORY_COLUMNS
) -> DataFrame:
    """Shares of all levels, however many: customer, ``column``, ``level``, ``share``."""
    counts = materialize(level_counts(df, customer_col, columns), "levels")
    counts = counts.where(named(customer_col).isNotNull())
    sums = counts.groupBy(customer_col, "column").agg(F.sum("lines").alias("_all"))
    joined = counts.join(sums, [customer_col, "column"])
    return joined.select(customer_col, "column", "level", (F.col("lines") / F.col("_all")).alias("share"))


def category_shares(
    df: DataFrame, levels: Levels, customer_col: str = "customer_id"
) -> DataFrame:
    """Share of each level among the customer's lines, in columns ``{column}_share__{level}``.

    Up to ``COUNTERS`` counters the lines are counted into them at once, a row per customer being
    all that is shuffled. More of them are too many to compare each line with, so the lines are
    counted per customer and level first. A customer whose columns are all NULL has no row.
    """
    known = df.where(named(customer_col).isNotNull())
    if len(levels) + sum(len(values) for values in levels.values()) > COUNTERS:
        counts = level_counts(known, customer_col, list(levels))
        return _wide_shares(counts, levels, customer_col, lambda column: F.when(F.col("column") == column, F.col("level")), lambda hit: F.sum(F.when(hit, F.col("lines"))))
    at = {c: f"_level{i}" for i, c in enumerate(levels)}
    texts = [(named(c) if c in df.columns else F.lit(None)).cast("string").alias(name) for c, name in at.items()]
    lines = known.select(named(customer_col), *texts)
    if at:
        lines = lines.where(F.coalesce(*at.values()).isNotNull())
    return _wide_shares(lines, levels, customer_col, lambda column: F.col(at[column]), F.count_if)


def _wide_shares(
    rows: DataFrame, levels: Levels, customer_col: str, level_of: Merge, lines_of: Callable[[Column], Column]
) -> DataFrame:
    """A counter per level over ``rows``: ``level_of`` gives a row's level in a column, ``lines_of`` the lines of rows hit."""
    counters, shares = [], []
    for c, (column, values) in enumerate(levels.items()):
        level = level_of(column)
        counters.append(lines_of(level.isNotNull()).alias(f"_all{c}"))
        for v, value in enumerate(values):
            hit = level == F.lit(value).cast("string")
            counters.append(lines_of(hit).alias(f"_n{c}_{v}"))
            share = safe_divide(F.col(f"_n{c}_{v}"), F.col(f"_all{c}"))
            shares.append(share.alias(f"{column}_share__{value}"))
    if not counters:
        return rows.select(customer_col).distinct()
    return rows.groupBy(customer_col).agg(*counters).select(customer_col, *shares)


def select_feature_columns(
    features: DataFrame, exclude: Iterable[str] = ("customer_id",)
) -> list[str]:
    """Numeric and boolean columns in order; reads the schema only."""
    left_out = set(exclude)
    return [
        f.name
        for f in features.schema
        if f.name not in left_out and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def align_features(features: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """Adds the feature columns that are absent, as 0.0."""
    return features.withColumns(
        {c: F.lit(0.0) for c in feature_columns if c not in features.columns}
    )


def numeric_defaults(df: DataFrame) -> DataFrame:
    """The numeric columns as numbers, missing ones 0; a missing recency stays missing."""
    filled = {c: F.coalesce(number(df, c), F.lit(0)) for c in DEFAULTED_COLUMNS if c in df.columns}
    if "recency_days" in df.columns:
        filled["recency_days"] = number(df, "recency_days")
    return df.withColumns(filled)
