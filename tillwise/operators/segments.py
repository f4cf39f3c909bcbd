"""Customer segments: K-means, profiles and names."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tillwise.functions.scalars import named
from tillwise.operators.features import select_feature_columns
from tillwise.operators.kmeans import KMeansFit, fit_kmeans, with_nearest
from tillwise.operators.ranks import VALUES_PER_RANGE, exact_quantiles
from tillwise.operators.silhouette import WITHIN, silhouettes
from tillwise.session import materialize, read_again

ROWS_PER_TASK = 20_000
MAX_SEGMENTS = 10_000
# Weight of each rank in the segment score, and names by score quartile.
RANK_WEIGHTS = {"revenue_total": 0.5, "orders": 0.3, "recency_days": 0.2}
SEGMENT_NAMES = ("Champions", "Loyal", "Potential", "At-Risk")


@dataclass(frozen=True)
class SegmentationResult:
    customers: DataFrame
    segment_profiles: DataFrame
    model: KMeansFit
    scaler: PipelineModel


def scale(scaler: PipelineModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the scaled vector of ``columns`` as ``scaled``."""
    return scaler.transform(_assembled(df, columns)).drop("_raw", "_centred")


def scaled_values(scaler: PipelineModel, columns: Sequence[str]) -> Column:
    """What ``scale`` gives, as an array: the same arithmetic on plain columns, no vector per row."""
    spread, product = scaler.stages
    parts = zip(columns, spread.mean, spread.std, product.getScalingVec())
    return F.array(
        *[
            (named(c).cast("double") - F.lit(float(mean))) * F.lit(1 / float(std) if std else 0.0) * F.lit(float(factor))
            for c, mean, std, factor in parts
        ]
    )


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = F.array(*[named(c).cast("double") for c in columns])
    return df.withColumn("_raw", array_to_vector(values))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> PipelineModel:
    """Scaling of ``columns`` to mean 0 and population deviation 1; apply it with ``scale``.

    Spark's scaler divides by the sample deviation; the last stage makes up the difference.
    """
    rows = df.count()
    factor = ((rows - 1) / rows) ** -0.5 if rows > 1 else 1.0
    return Pipeline(
        stages=[
            StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=True),
            ElementwiseProduct(
                inputCol="_centred",
                outputCol="scaled",
                scalingVec=Vectors.dense([factor] * len(columns)),
            ),
        ]
    ).fit(_assembled(df, columns).select("_raw"))


def few_tasks(rows: int) -> int:
    """How many tasks ``rows`` deserve in jobs that pass over them often."""
    return max(1, math.ceil(rows / ROWS_PER_TASK))


def scaled_points(scaler: PipelineModel, features: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """The scaled features as arrays ``x``, in few tasks."""
    points = features.select(scaled_values(scaler, columns).alias("x"))
    return points.coalesce(few_tasks(rows))


def _numeric_features(features: DataFrame, customer_col: str) -> list[str]:
    names = select_feature_columns(features, exclude=(customer_col,))
    return [c for c in names if not isinstance(features.schema[c].dataType, T.BooleanType)]


def segment_customers(
    features: DataFrame,
    customer_col: str = "customer_id",
    n_clusters: int = 4,
    random_state: int = 42,
) -> SegmentationResult:
    """K-means over all numeric (not boolean) features; adds ``segment_id``.

    The features are stored first; ``fit_kmeans`` keeps the scaled points for its passes, one per
    iteration for all starts together.
    """
    if customer_col not in features.columns:
        raise ValueError(f"Missing column: {customer_col}")
    columns = _numeric_features(features, customer_col)
    features = materialize(features, "features")
    rows = features.count()
    scaler = fit_scaler(features, columns)
    points = scaled_points(scaler, features, columns, rows)
    model = fit_kmeans(points, [n_clusters], random_state, few_tasks(rows))[n_clusters]
    placed = features.withColumn("segment_id", model.nearest(scaled_values(scaler, columns)))
    customers = materialize(placed, "segmented")
    return SegmentationResult(
        customers=customers,
        segment_profiles=segment_profiles(customers, columns),
        model=model,
        scaler=scaler,
    )


def segment_profiles(
    customers: DataFrame, columns: Sequence[str], segment_col: str = "segment_id"
) -> DataFrame:
    """Mean of each feature per segment."""
    return (
        customers.groupBy(segment_col)
        .agg(*[F.avg(named(c)).alias(c) for c in columns])
        .orderBy(segment_col)
    )


def segment_medians(
    customers: DataFrame, columns: Sequence[str], values_per_range: int = VALUES_PER_RANGE
) -> DataFrame:
    """Exact median of each column per ``segment_id``; 0 where a segment has no value.

    The columns are melted into one table, so their values are counted and ranked together.
    """
    known = customers.where(F.col("segment_id").isNotNull())
    value = lambda c: F.struct(F.lit(c).alias("column"), named(c).cast("double").alias("value"))
    melted = known.select("segment_id", F.explode(F.array(*[value(c) for c in columns])).alias("_x"))
    melted = materialize(melted.select("segment_id", "_x.column", "_x.value"), "melted")
    medians = exact_quantiles(
        melted, "value", {"median": 0.5}, ["segment_id", "column"], values_per_range
    )
    picked = [F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns]
    ids = melted.select("segment_id").distinct()
    found = medians.groupBy("segment_id").agg(*picked)
    return ids.join(found, "segment_id", "left").fillna(0.0, subset=list(columns))


def segment_ranks(medians: DataFrame) -> DataFrame:
    """Dense ranks of the medians, the most recent segment highest, and the ``score``.

    There is one row per segment, so a single task may rank them.
    """
    score, ranks = None, {}
    for column, weight in RANK_WEIGHTS.items():
        if column not in medians.columns:
            rank = F.lit(1)
        else:
            # Fewest days rank highest, which equals ranking the days downward.
            way = F.desc(column) if column == "recency_days" else F.asc(column)
            rank = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(way))
        ranks[f"{column}_rank"] = rank
        term = F.col(f"{column}_rank") * F.lit(weight)
        score = term if score is None else score + term
    return medians.withColumns(ranks).withColumn("score", score)


def name_by_score(ranked: DataFrame) -> DataFrame:
    """Adds the score quartiles and ``segment_name``."""
    everyone = Window.partitionBy(F.lit(0))
    quarters = F.percentile("score", F.array(F.lit(0.75), F.lit(0.5), F.lit(0.25)))
    out = ranked.withColumn("_quarters", quarters.over(everyone)).withColumns(
        {f"q{p}": F.col("_quarters")[i] for i, p in enumerate((75, 50, 25))}
    )
    best, good, fair, rest = SEGMENT_NAMES
    name = (
        F.when(F.col("score") >= F.col("q75"), best)
        .when(F.col("score") >= F.col("q50"), good)
        .when(F.col("score") >= F.col("q25"), fair)
        .otherwise(rest)
    )
    return out.withColumn("segment_name", name).drop("_quarters")


def name_segments(customers: DataFrame, values_per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """Adds ``segment_name`` by revenue, order count and recency of the segment's median."""
    if "segment_id" not in customers.columns:
        raise ValueError("Expected column: segment_id")
    columns = [c for c in RANK_WEIGHTS if c in customers.columns]
    if not columns:
        return customers.withColumn("segment_name", F.col("segment_id").cast("string"))
    customers = read_again(customers, "to-name")
    medians = segment_medians(customers, columns, values_per_range)
    names = name_by_score(segment_ranks(medians)).select("segment_id", "segment_name")
    # One row per segment. Read as values, so that the customers are never shuffled for them.
    rows = names.limit(MAX_SEGMENTS + 1).collect()
    if len(rows) > MAX_SEGMENTS:
        raise ValueError(f"More than {MAX_SEGMENTS} segments.")
    few = customers.sparkSession.createDataFrame(rows, names.schema)
    kept = [named(c) for c in customers.columns]
    return customers.join(F.broadcast(few), "segment_id", "left").select(*kept, "segment_name")


def silhouette_scores(
    features: DataFrame,
    k_min: int = 2,
    k_max: int = 8,
    random_state: int = 42,
    customer_col: str = "customer_id",
    exact_rows: int | None = None,
    within: float = WITHIN,
) -> DataFrame:
    """Mean silhouette in plain distance per number of segments.

    All numbers of segments are fitted together and share the distances of their silhouettes, which are
    exact, by all pairs of customers. Only with ``exact_rows``, those of more customers are estimated within
    ``within``; see ``silhouette``. A number that gives a single segment, as few customers differ, has no row.
    """
    spark = features.sparkSession
    columns = _numeric_features(features, customer_col)
    features = materialize(features, "features")
    rows, scores = features.count(), []
    ks = range(max(int(k_min), 2), min(int(k_max), rows - 1) + 1)
    if columns and rows >= 3 and len(ks):
        points = scaled_points(fit_scaler(features, columns), features, columns, rows)
        fits = fit_kmeans(points, ks, random_state, few_tasks(rows))
        placed = with_nearest(points, list(fits.values())).persist(StorageLevel.MEMORY_AND_DISK)
        found = silhouettes(
            placed, F.col("x"), F.col("of"), [len(fit.centres) for fit in fits.values()], exact_rows, within,
            tasks=few_tasks(rows), rows=rows,
        )
        scores = [(float(k), score) for k, score in zip(fits, found) if score is not None]
        placed.unpersist()
    return spark.createDataFrame(scores, "k double, silhouette double")
