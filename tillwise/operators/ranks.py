"""Exact global ranks and quantiles without sorting everything in one task.

The base is a table of distinct values with the number of rows at and below each. The
values are cut into ranges of similar size; running counts are taken inside a range and
shifted by the counts of the ranges before it. The cuts are approximate, the counts exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from tillwise.functions.scalars import real
from tillwise.operators.joins import left_join_unique
from tillwise.session import materialize

MAX_RANGES = 2000
VALUES_PER_RANGE = 1_000_000


def value_counts_below(
    df: DataFrame,
    value_col: str,
    by: Sequence[str] = (),
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Per group and distinct value: rows with it (``n``), below it (``below``), in all (``total``).

    NULL and NaN are no values. Output columns: ``by``, ``value``, ``n``, ``below``, ``total``.
    """
    by = list(by)
    counts = (
        df.select(*by, real(df, value_col).alias("value"))
        .dropna()
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = materialize(counts, "values")
    ranges = min(MAX_RANGES, math.ceil(counts.count() / values_per_range))
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(counts.approxQuantile("value", shares, 0.1 / ranges)))
        counts = Bucketizer(
            splits=[-math.inf, *cuts, math.inf], inputCol="value", outputCol="_range"
        ).transform(counts)
    else:
        counts = counts.withColumn("_range", F.lit(0.0))

    # One row per group and range, MAX_RANGES per group at most.
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = (
        counts.groupBy(*by, "_range")
        .agg(F.sum("n").alias("_in_range"))
        .select(
            *by,
            "_range",
            F.sum("_in_range").over(groups).alias("total"),
            F.coalesce(
                F.sum("_in_range").over(
                    groups.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    running = (
        Window.partitionBy(*by, "_range")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.join(offsets, [*by, "_range"]).select(
        *by,
        "value",
        "n",
        (F.col("_before") + F.coalesce(F.sum("n").over(running), F.lit(0))).alias("below"),
        "total",
    )


def percent_rank_average(counts: DataFrame) -> DataFrame:
    """Adds ``pct_rank``: mean rank of the rows that share the value, over the row count."""
    return counts.withColumn(
        "pct_rank", (F.col("below") + (F.col("n") + 1) / 2) / F.col("total")
    )


def with_percent_rank(
    df: DataFrame,
    value_col: str,
    out_col: str = "pct_rank",
    counts: DataFrame | None = None,
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """``df`` with the percent rank of ``value_col``; a missing value has a missing rank."""
    if counts is None:
        counts = value_counts_below(df, value_col, values_per_range=values_per_range)
    ranked = percent_rank_average(counts).select(
        F.col("value").alias("_value"), F.col("pct_rank").alias(out_col), "n"
    )
    keyed = df.withColumn("_value", real(df, value_col))
    return left_join_unique(keyed, ranked, "_value", rows_per_key="n").drop("_value")


def quantiles(
    counts: DataFrame, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles of a ``value_counts_below`` table, one column per entry."""
    spots, results = [], []
    for i, (name, p) in enumerate(probabilities.items()):
        place = (F.col("total") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            inside = (F.col("below") <= index) & (index < F.col("below") + F.col("n"))
            spots.append(F.max(F.when(inside, F.col("value"))).alias(f"_{side}{i}"))
        spots.append(F.max(place - F.floor(place)).alias(f"_part{i}"))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        results.append((low + (high - low) * F.col(f"_part{i}")).alias(name))
    return counts.groupBy(*by).agg(*spots).select(*by, *results)


def exact_quantiles(
    df: DataFrame,
    value_col: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    values_per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    counts = value_counts_below(df, value_col, by, values_per_range)
    return quantiles(counts, probabilities, by)
