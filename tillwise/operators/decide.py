"""Recommended action and decision score per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.operators.ranks import (
    VALUES_PER_RANGE,
    quantiles,
    value_counts_below,
    with_percent_rank,
)
from tillwise.session import materialize

# The texts of the actions, and the limits that no parameter sets.
RETENTION = "Retention: win-back offer + reactivation outreach"
PROTECT = "Protect high-value: VIP support + targeted incentive"
UPSELL = "Upsell: premium bundle recommendation"
ENGAGE = "Engage: loyalty points + referral prompt"
NURTURE = "Nurture: personalized recommendations + light discount"
ENGAGE_RISK = 0.2
ENGAGE_RECENCY = 30


def recommend_actions(
    customers: DataFrame,
    churn_high_threshold: float = 0.7,
    recency_threshold_days: float = 90,
    high_value_quantile: float = 0.75,
    protect_risk_threshold: float = 0.4,
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Adds ``recommended_action`` and ``decision_score``.

    An absent column counts as 0. A missing value satisfies no condition, and a missing
    risk or revenue gives no score. The revenue quantile and the revenue ranks come from
    one table of value counts. The customers are stored first, as both it and the result
    read them.
    """
    absent = [
        c for c in ("churn_risk", "revenue_total", "recency_days") if c not in customers.columns
    ]
    df = materialize(customers.withColumns({c: F.lit(0.0) for c in absent}), "to-decide")
    counts = value_counts_below(df, "revenue_total", values_per_range=values_per_range)
    high_value = quantiles(counts, {"q": high_value_quantile}).scalar()

    risk, recency = F.col("churn_risk"), F.col("recency_days")
    valuable = F.col("revenue_total") >= high_value
    action = (
        F.when((risk >= churn_high_threshold) | (recency >= recency_threshold_days), RETENTION)
        .when(valuable & (risk >= protect_risk_threshold), PROTECT)
        .when(valuable, UPSELL)
        .when((risk <= ENGAGE_RISK) & (recency <= ENGAGE_RECENCY), ENGAGE)
        .otherwise(NURTURE)
    )
    ranked = with_percent_rank(df, "revenue_total", "_rank", counts)
    return ranked.withColumns(
        {
            "recommended_action": action,
            "decision_score": (1 - risk) * 0.5 + F.col("_rank") * 0.5,
        }
    ).drop("_rank")


def with_risks(customers: DataFrame, risks: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """``customers`` with ``churn_risk``; missing for a customer that has none."""
    return customers.join(risks.select(customer_col, "churn_risk"), customer_col, "left")


def decision_table(decisions: DataFrame, customer_col: str = "customer_id") -> DataFrame:
    """The decisions, the riskiest customers first and those without a risk last."""
    return decisions.select(
        customer_col, "segment_name", "churn_risk", "recommended_action"
    ).orderBy(F.desc_nulls_last("churn_risk"), customer_col)
