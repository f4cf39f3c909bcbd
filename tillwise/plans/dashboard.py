"""The whole run: summaries, funnel, segments, churn risk and decisions from one table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from tillwise.operators.churn import (
    ChurnModelResult,
    class_counts,
    forward_churn_labels,
    predict_churn_risk,
    risk_histogram,
    top_risks,
    train_churn_model,
)
from tillwise.operators.decide import decision_table, recommend_actions, with_risks
from tillwise.operators.features import (
    category_levels,
    customer_features,
    customer_features_asof,
    select_feature_columns,
)
from tillwise.operators.funnel import compute_funnel
from tillwise.operators.market import headline_numbers, market_research_summary
from tillwise.operators.recency import customer_recency, dated_lines, ensure_recency
from tillwise.operators.segments import name_segments, segment_customers
from tillwise.operators.windows import (
    choose_as_of,
    filter_time_window,
    history,
    preview,
    recent,
    sample_customers,
)
from tillwise.session import materialize
from tillwise.sources.readers import write_table


# The columns that decisions are made from, and those that ``ensure_recency`` adds.
DECIDED_BY = ("customer_id", "segment_name", "revenue_total", "recency_days")
RECENCY_COLUMNS = ("last_purchase_date", "recency_days")


@dataclass(frozen=True)
class ChurnRun:
    """Model and risks; both are None when the labels hold a single class."""

    as_of: datetime
    model: ChurnModelResult | None
    risks: DataFrame | None


def run_churn(df: DataFrame, horizon_days: int = 90, lookback_days: int = 180) -> ChurnRun:
    """Learns from the customers known one horizon before the newest row, scores today's.

    The newest moment is read once as a plain value, so the history filters reach the scan, and
    lines that come from joins are joined once for all three of their periods.
    """
    as_of = choose_as_of(df, horizon_days)
    df = recent(df, as_of, lookback_days)
    # The model knows the levels of its own period only, so the other one's are not looked for.
    levels = category_levels(history(df, as_of, lookback_days))
    past = customer_features_asof(df, as_of, lookback_days, levels=levels, once=True)
    past = materialize(past, "past")
    labels = materialize(forward_churn_labels(df, as_of, past, horizon_days), "labels")
    result, risks = None, None
    if len(class_counts(labels, "churn")) == 2:
        result = train_churn_model(past, labels, select_feature_columns(past))
        newest = as_of + timedelta(days=horizon_days)
        present = customer_features_asof(df, newest, lookback_days, levels=levels, once=True)
        risks = predict_churn_risk(result, present)
    return ChurnRun(as_of, result, risks)


def run_dashboard(
    df: DataFrame,
    window: str = "all",
    n_clusters: int = 4,
    horizon_days: int = 90,
    max_customers: int | None = None,
    max_category_levels: int | None = None,
    add_recency: bool = False,
) -> dict[str, DataFrame]:
    """Named result tables of cleaned transactions.

    ``max_customers`` samples whole customers first; by default all are used. The chosen
    lines are stored once, since every table reads them; what is returned stays lazy.

    ``add_recency`` is for lines that ``coerce_columns`` has typed and that lack the recency of
    ``ensure_recency``. The results are those for lines that have it, but when all lines are used
    it is counted and joined per customer, so the lines are joined and stored just once.
    """
    apart = add_recency and window == "all" and max_customers is None
    apart = apart and {"customer_id", "order_date"} <= set(df.columns) and not set(RECENCY_COLUMNS) & set(df.columns)
    if apart:
        df = dated_lines(df)
    elif add_recency:
        df = ensure_recency(df)
    if max_customers is not None:
        df = sample_customers(df, max_customers)
    df = materialize(filter_time_window(df, window), "lines")

    out = {"headline": headline_numbers(df)}
    out |= market_research_summary(df)
    out["funnel"] = compute_funnel(df, unit_col="order_id")

    segments = segment_customers(
        customer_features(df, max_category_levels=max_category_levels, since_purchase=apart, once=True),
        n_clusters=n_clusters,
    )
    named = name_segments(segments.customers)
    out["segments"] = named
    out["segment_profiles"] = segments.segment_profiles

    if "order_date" in df.columns:
        churn = run_churn(df, horizon_days)
        if churn.risks is not None:
            risks = materialize(churn.risks, "risks")
            decided_by = named.select(*[c for c in named.columns if c in DECIDED_BY])
            decisions = recommend_actions(with_risks(decided_by, risks))
            out["risk_histogram"] = risk_histogram(risks)
            out["top_risks"] = top_risks(risks)
            out["decisions"] = decision_table(decisions)
    order = [c for c in ("order_date", "order_id", "stock_code") if c in df.columns]
    first = preview(df, order or df.columns)
    if apart:
        recency = customer_recency(df, once=True).select("customer_id", *RECENCY_COLUMNS)
        first = first.join(recency, "customer_id", "left").select(*df.columns, *RECENCY_COLUMNS).orderBy(*order)
    out["preview"] = first
    return out


def write_dashboard(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Writes every table as Parquet below ``folder``."""
    return [write_table(frame, f"{folder.rstrip('/')}/{name}") for name, frame in tables.items()]
