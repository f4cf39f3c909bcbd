"""Churn: labels that look ahead, a balanced logistic regression, its metrics and scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillwise.functions.scalars import named, safe_divide
from tillwise.operators.features import align_features
from tillwise.operators.logistic import LogisticFit, fit_logistic
from tillwise.operators.ranks import value_counts_below
from tillwise.operators.segments import few_tasks, fit_scaler, scaled_values
from tillwise.operators.windows import future_purchases
from tillwise.session import materialize

# Fixed values of the model: share held out, iteration limit, decision threshold.
TEST_SHARE = 0.25
MAX_ITERATIONS = 2000
THRESHOLD = 0.5


@dataclass(frozen=True)
class ChurnModelResult:
    model: LogisticFit
    scaler: PipelineModel
    feature_columns: list[str]
    metrics: dict[str, float]
    metadata: dict[str, object] = field(default_factory=dict)


def forward_churn_labels(
    df: DataFrame,
    as_of: datetime,
    customers: DataFrame,
    horizon_days: int = 90,
    customer_col: str = "customer_id",
    time_col: str = "order_date",
    purchase_col: str = "purchased",
) -> DataFrame:
    """``churn`` = 1 for each of ``customers`` without a purchase within the horizon."""
    if time_col not in df.columns:
        raise ValueError(f"Missing column: {time_col}")
    customers = customers.select(F.col(customer_col).cast("string").alias(customer_col))
    if customer_col not in df.columns:
        return customers.withColumn("churn", F.lit(1))
    buyers = (
        future_purchases(df, as_of, horizon_days, time_col, purchase_col)
        .where(F.col(customer_col).isNotNull())
        .select(F.col(customer_col).cast("string").alias(customer_col))
        .distinct()
        .withColumn("_bought", F.lit(True))
    )
    churned = F.col("_bought").isNull().cast("int")
    return customers.join(buyers, customer_col, "left").select(
        customer_col, churned.alias("churn")
    )


def with_labels(
    features: DataFrame,
    labels: DataFrame,
    default: int,
    customer_col: str = "customer_id",
    label_col: str = "churn",
) -> DataFrame:
    """``features`` with the label of each customer as ``label``; ``default`` if unlisted."""
    keyed = labels.select(customer_col, F.col(label_col).cast("int").alias("label"))
    return features.join(keyed, customer_col, "left").withColumn(
        "label", F.coalesce("label", F.lit(default))
    )


def class_counts(df: DataFrame, label_col: str = "label") -> dict[int, int]:
    rows = df.groupBy(label_col).count().where(F.col(label_col).isin(0, 1)).collect()
    return {row[0]: row[1] for row in rows}


def split_order(customer: Column, seed: int) -> Column:
    """A seeded hash that puts customers in a random but repeatable order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), customer.cast("string")))


def stratified_split(
    df: DataFrame,
    label_col: str = "label",
    customer_col: str = "customer_id",
    seed: int = 42,
    test_share: float = TEST_SHARE,
) -> DataFrame:
    """Adds ``is_test`` for the same share of every class, exactly and repeatably.

    Customers are ranked by hash within slices of the hash, each a small part of its class,
    and shifted by the sizes of the slices before.
    """
    marked = df.withColumn("_draw", split_order(F.col(customer_col), seed)).withColumn(
        "_slice", F.substring("_draw", 1, 3)
    )
    # At most 4096 slices per class.
    per_class = Window.partitionBy(label_col)
    before = per_class.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(label_col, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select(
        label_col,
        "_slice",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(per_class).alias("_class_size"),
    )
    place = F.row_number().over(
        Window.partitionBy(label_col, "_slice").orderBy("_draw", customer_col)
    )
    wanted = F.round(F.col("_class_size") * F.lit(float(test_share)))
    return (
        marked.join(sizes, [label_col, "_slice"])
        .withColumn("is_test", F.col("_before") + place <= wanted)
        .select(*[named(c) for c in df.columns], "is_test")
    )


def _fit(train: DataFrame, feature_columns: list[str]) -> tuple[PipelineModel, LogisticFit]:
    """Balanced regression on scaled features, in a handful of passes.

    The penalty 1/rows equals a unit inverse-strength penalty on the summed loss, because
    the balanced weights add up to the number of rows.
    """
    counts = class_counts(train)
    if len(counts) < 2:
        raise ValueError("The training labels hold a single class.")
    rows = sum(counts.values())
    scaler = fit_scaler(train, feature_columns)
    weight = F.when(F.col("label") == 1, rows / (2 * counts[1])).otherwise(rows / (2 * counts[0]))
    ready = train.select(
        scaled_values(scaler, feature_columns).alias("x"), F.col("label").cast("double").alias("label"), weight.alias("weight")
    )
    tasks = few_tasks(rows)
    ready = ready.where("label IN (0, 1)").coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_logistic(ready, len(feature_columns), rows, MAX_ITERATIONS, tasks)
    ready.unpersist()
    return scaler, model


def _doubles(features: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """The model's columns in its types; other columns stay as they are."""
    aligned = align_features(features, feature_columns)
    return aligned.withColumns({c: named(c).cast("double") for c in feature_columns})


def _score(
    scaler: PipelineModel, model: LogisticFit, df: DataFrame, columns: list[str]
) -> DataFrame:
    return df.withColumn("churn_risk", model.probability(scaled_values(scaler, columns)))


def train_churn_model(
    features: DataFrame,
    labels: DataFrame,
    feature_columns: Sequence[str],
    random_state: int = 42,
    customer_col: str = "customer_id",
) -> ChurnModelResult:
    """Fits on three quarters of the customers and measures on the rest.

    ``labels`` has one ``churn`` per customer; an unlisted customer counts as not churned.
    """
    columns = list(feature_columns)
    labelled = with_labels(_doubles(features, columns), labels, 0, customer_col)
    split = stratified_split(labelled, "label", customer_col, random_state)
    used = [named(c) for c in (customer_col, *columns, "label", "is_test")]
    split = materialize(split.select(*used), "split")
    scaler, model = _fit(split.where(~F.col("is_test")), columns)
    metrics = classification_metrics(_score(scaler, model, split.where("is_test"), columns))
    return ChurnModelResult(model, scaler, columns, metrics)


def train_churn_model_time_split(
    train_features: DataFrame,
    test_features: DataFrame,
    feature_columns: Sequence[str],
    train_labels: DataFrame | str = "churn",
    test_labels: DataFrame | str = "churn",
    customer_col: str = "customer_id",
) -> ChurnModelResult:
    """Fits on one period and measures on another.

    Labels are a column of the features, or a frame with one ``churn`` per customer, where
    an unlisted customer counts as churned.
    """
    columns = list(feature_columns)

    def labelled(features: DataFrame, labels: DataFrame | str) -> DataFrame:
        ready = _doubles(features, columns)
        if isinstance(labels, str):
            ready = ready.withColumn("label", F.col(labels).cast("int"))
        else:
            ready = with_labels(ready, labels, 1, customer_col)
        return materialize(ready.select(*[named(c) for c in columns], "label"), "labelled")

    scaler, model = _fit(labelled(train_features, train_labels), columns)
    test = _score(scaler, model, labelled(test_features, test_labels), columns)
    metrics, size = classification_metrics(test), test.count()
    return ChurnModelResult(model, scaler, columns, metrics, {"test_size": size})


def predict_churn_risk(
    result: ChurnModelResult, features: DataFrame, customer_col: str = "customer_id"
) -> DataFrame:
    """``churn_risk``, the probability of churn, per row of ``features``."""
    ready = _doubles(features, result.feature_columns)
    return _score(result.scaler, result.model, ready, result.feature_columns).select(customer_col, "churn_risk")


def confusion(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Accuracy, precision, recall and F1 of ``churn_risk`` against ``label``, in one row."""
    hit, said = F.col("label") == 1, F.col("churn_risk") >= threshold
    counts = scored.agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
        F.count_if(~hit & ~said).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": safe_divide(tp + tn, tp + fp + fn + tn),
            "precision": safe_divide(tp, tp + fp),
            "recall": safe_divide(tp, tp + fn),
            "f1": safe_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve in one row, NULL when only one class occurs.

    It follows from the mean ranks of the positive rows, with tied scores sharing a rank.
    """
    known = scored.where(F.col("label").isNotNull() & F.col("churn_risk").isNotNull())
    ranks = value_counts_below(known, "churn_risk").select(
        "value", (F.col("below") + (F.col("n") + 1) / 2).alias("mean_rank")
    )
    hits = known.groupBy(F.col("churn_risk").alias("value")).agg(
        F.count_if(F.col("label") == 1).alias("hits"), F.count(F.lit(1)).alias("rows")
    )
    sums = hits.join(ranks, "value").agg(
        F.sum(F.col("hits") * F.col("mean_rank")).alias("rank_sum"),
        F.sum("hits").cast("double").alias("positives"),
        F.sum(F.col("rows") - F.col("hits")).cast("double").alias("negatives"),
    )
    p, n = F.col("positives"), F.col("negatives")
    area = F.try_divide(F.col("rank_sum") - p * (p + 1) / 2, p * n)
    return sums.select(area.alias("roc_auc"))


def classification_metrics(scored: DataFrame) -> dict[str, float]:
    """Metrics of scored rows; ``roc_auc`` only when both classes occur."""
    scored = materialize(scored.select("label", "churn_risk"), "scored")
    row = confusion(scored).select("accuracy", "precision", "recall", "f1").first()
    metrics = row.asDict()
    area = roc_auc(scored).first()[0]
    if area is not None:
        metrics["roc_auc"] = area
    return metrics


def top_risks(scored: DataFrame, limit: int = 50, customer_col: str = "customer_id") -> DataFrame:
    return (
        scored.select(customer_col, "churn_risk")
        .orderBy(F.desc_nulls_last("churn_risk"), customer_col)
        .limit(limit)
    )


def risk_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Customers per equal slice of the risk range; a risk of 1 falls in the last slice."""
    place = F.least(F.floor(F.col("churn_risk") * bins), F.lit(bins - 1))
    return (
        scored.where(F.col("churn_risk").isNotNull())
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("bin")
    )
