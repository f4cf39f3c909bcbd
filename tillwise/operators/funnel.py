"""Visit, cart and purchase counts and the rates between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillwise.functions.scalars import flag, named, safe_divide
from tillwise.operators.joins import left_join_unique
from tillwise.schema import FUNNEL_STAGES


def compute_funnel(
    df: DataFrame,
    groupby: str | None = None,
    funnel_cols: Sequence[str] = FUNNEL_STAGES,
    unit_col: str | None = None,
) -> DataFrame:
    """Counts per stage and the three rates, overall or per ``groupby`` value.

    With ``unit_col`` each unit counts with its largest value per stage, so that an order
    of many lines counts once. Rows without a unit or group are then left out. A
    ``groupby`` or ``unit_col`` that is no column is ignored.
    """
    stages = list(funnel_cols)
    absent = [c for c in FUNNEL_STAGES if c not in stages]
    if absent:
        raise ValueError(f"The rates need the stages {', '.join(absent)}")
    groupby = groupby if groupby in df.columns else None
    unit_col = unit_col if unit_col in df.columns else None

    values = {c: flag(df, c) if c in df.columns else F.lit(0).cast("bigint") for c in stages}
    keys = list(dict.fromkeys(c for c in (unit_col, groupby) if c))
    df = df.select(*keys, *[column.alias(c) for c, column in values.items()])
    if keys:
        df = df.dropna(subset=keys)
    if unit_col:
        df = df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stages])
    counts = df.groupBy(*([groupby] if groupby else [])).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_count") for c in stages]
    )
    visited, carts, bought = (F.col(f"{c}_count") for c in FUNNEL_STAGES)
    funnel = counts.withColumns(
        {
            "visit_to_cart_rate": safe_divide(carts, visited),
            "cart_to_purchase_rate": safe_divide(bought, carts),
            "visit_to_purchase_rate": safe_divide(bought, visited),
        }
    )
    return funnel.orderBy(groupby) if groupby else funnel


def bottleneck() -> Column:
    """The weaker of the two steps, for each row of a funnel."""
    return F.when(
        F.col("visit_to_cart_rate") < F.col("cart_to_purchase_rate"), "visit_to_cart"
    ).otherwise("cart_to_purchase")


def bottleneck_stage(funnel: DataFrame) -> str:
    """The weaker step of the funnel's first row; 'unknown' for a funnel without rows.

    The first row of a grouped funnel is that of the smallest group value.
    """
    order = [c for c in funnel.columns if not c.endswith(("_count", "_rate"))]
    first = funnel.orderBy(*order) if order else funnel
    row = first.select(bottleneck()).head()
    return row[0] if row else "unknown"


def attach_funnel_counts(
    df: DataFrame,
    events: DataFrame,
    unit_col: str = "order_id",
    type_col: str = "event_type",
    visit_type: str = "view",
    cart_type: str = "click",
) -> DataFrame:
    """Lines with ``visited`` and ``added_to_cart`` counted from an event table.

    A unit that has lines was bought, hence visited and put in a cart at least once:
    visited >= added_to_cart >= 1. Lines without a unit get 0.
    """
    if unit_col not in df.columns:
        return df
    counted = (
        events.where(F.col(unit_col).isNotNull())
        .groupBy(unit_col)
        .agg(
            F.count_if(F.col(type_col) == visit_type).alias("_visits"),
            F.count_if(F.col(type_col) == cart_type).alias("_carts"),
        )
    )
    plain = df.drop("visited", "added_to_cart")
    joined = left_join_unique(plain, counted, unit_col)
    one = F.lit(1).cast("bigint")
    carts = F.greatest(F.coalesce("_carts", one), one)
    visits = F.greatest(F.coalesce("_visits", one), carts)
    has_unit = F.col(unit_col).isNotNull()
    out = joined.withColumns(
        {
            "visited": F.when(has_unit, visits).otherwise(0),
            "added_to_cart": F.when(has_unit, carts).otherwise(0),
        }
    ).drop("_visits", "_carts")
    if "purchased" not in out.columns:
        out = out.withColumn("purchased", one)
    order = [*df.columns, *[c for c in out.columns if c not in df.columns]]
    return out.select(*[named(c) for c in order])
