import math
from pathlib import Path
from random import Random

import numpy as np
import pytest
from conftest import at, rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tillwise import session
from tillwise.plans import dashboard
from tillwise.operators import churn, decide, features, ranks, recency, segments


def lines(frame):
    return frame(
        "customer_id string, order_id string, order_date timestamp_ntz, visited int, "
        "added_to_cart int, purchased int, total_spend double, discount double, channel string",
        ("a", "o1", at("2020-01-01"), 1, 1, 1, 10.0, 5.0, "web"),
        ("a", "o1", at("2020-01-01"), 1, 0, 0, 5.0, None, "app"),
        ("a", "o2", at("2020-02-01"), 1, 1, 0, None, 10.0, None),
        ("b", "o3", at("2020-01-15T12:00"), 0, 0, 0, 7.0, None, None),
        ("b", None, at("2020-01-10"), 0, 0, 1, 1.0, None, None),
        (None, "o4", at("2020-03-01"), 1, 1, 1, 9.0, 0.0, "web"),
        ("c", "o5", None, 1, 0, 0, 0.0, 0.0, "fax"),
    )


def test_features_of_the_whole_table(frame):
    got = {r["customer_id"]: r.asDict() for r in features.customer_features(lines(frame)).collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["orders"], a["visits"], a["added_to_cart"], a["purchases"]) == (2, 3, 2, 1)
    assert (a["revenue_total"], a["avg_order_value"], a["avg_discount"]) == (15, 7.5, 5)
    assert a["recency_days"] == 29 and a["cart_rate"] == 2 / 3 and a["cart_to_purchase_rate"] == 0.5
    assert (a["channel_share__app"], a["channel_share__web"], a["channel_share__fax"]) == (0.5, 0.5, 0)
    assert a["revenue_total_log1p"] == pytest.approx(math.log1p(15))
    # b's purchase has no order, so it is no purchased order; its channels are unknown.
    assert (b["orders"], b["purchases"], b["recency_days"], b["channel_share__web"]) == (1, 0, 45, 0)
    assert (b["cart_rate"], b["avg_discount"], c["recency_days"]) == (0, 0, 0)


def test_features_with_missing_columns(frame):
    df = frame("customer_id string, price string, quantity int", ("a", "2.5", 2), ("a", "x", 1))
    row = features.customer_features(df).first().asDict()
    assert (row["orders"], row["visits"], row["purchases"], row["revenue_total"]) == (2, 2, 2, 5)
    assert (row["added_to_cart"], row["recency_days"], row["avg_discount"]) == (0, 0, 0)
    with pytest.raises(ValueError):
        features.customer_features(df.drop("customer_id"))
    given = frame("customer_id string, recency_days double", ("a", 4.0), ("a", 2.0), ("b", None))
    got = rows(features.customer_features(given).select("customer_id", "recency_days"), "customer_id")
    assert got == [("a", 2.0), ("b", 0.0)]


def test_features_as_of(frame):
    df = lines(frame)
    out = features.customer_features_asof(df, at("2020-01-15T12:00"), 180)
    got = {r["customer_id"]: r.asDict() for r in out.collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["orders"] == 1 and got["a"]["recency_days"] == 14
    assert got["a"]["avg_discount"] == 5 and got["b"]["recency_days"] == 5
    unbought = df.withColumn("purchased", F.lit(0))
    short = features.customer_features_asof(unbought, at("2020-02-01"), 20).collect()
    assert {r["customer_id"]: r["recency_days"] for r in short} == {"a": 21, "b": 21}
    whole = features.customer_features_asof(unbought, at("2020-02-01"), None).collect()
    assert {r["customer_id"]: r["recency_days"] for r in whole} == {"a": 32, "b": 32}
    assert features.customer_features_asof(df, at("2019-01-01"), 10).count() == 0
    with pytest.raises(ValueError):
        features.customer_features_asof(df.drop("order_date"), at("2020-01-01"))


def test_columns_with_too_many_levels_are_left_out(spark):
    df = spark.range(4000).select(
        F.lit("a").alias("customer_id"),
        (F.col("id") % 30).cast("string").alias("channel"),
        F.when(F.col("id") > 0, (F.col("id") % 31).cast("string")).alias("device"),
        F.when(F.col("id") % 3 == 0, "most").otherwise(F.col("id").cast("string")).alias("location"),
        F.lit(None).cast("string").alias("category"),
        (F.col("id") % 2).alias("payment_method"),
    )
    with pytest.warns(UserWarning, match="device: 31 levels"):
        levels = features.category_levels(df, 30)
    assert set(levels) == {"channel", "category", "payment_method"}
    assert levels["channel"] == sorted(str(i) for i in range(30))
    assert levels["category"] == [] and levels["payment_method"] == [0, 1]
    with pytest.raises(ValueError, match="location"):
        features.customer_features(df)
    whole = features.customer_features(df.drop("location"))
    assert sum(c.startswith("device_share__") for c in whole.columns) == 31
    out = features.customer_features(df, max_category_levels=30)
    shares = [c for c in out.columns if "_share__" in c]
    assert len(shares) == 32 and "payment_method_share__1" in shares
    row = out.first()
    assert sum(row[c] for c in shares if c.startswith("channel")) == pytest.approx(1)


def test_long_shares_hold_every_level(spark):
    df = spark.range(4000).select(
        (F.col("id") % 3).cast("string").alias("customer_id"),
        (F.col("id") % 1500).cast("string").alias("location"),
        F.when(F.col("id") % 2 == 0, "x").alias("channel"),
    )
    got = features.category_shares_long(df).groupBy("customer_id", "column").agg(
        F.sum("share").alias("all"), F.count("*").alias("n")
    )
    found = {(r["customer_id"], r["column"]): (round(r["all"], 9), r["n"]) for r in got.collect()}
    assert found == {**{(str(k), "location"): (1.0, 500) for k in range(3)}, **{(str(k), "channel"): (1.0, 1) for k in range(3)}}


def test_features_read_the_lines_twice(spark, shared_folder):
    from tillwise.sources import star_schema as star

    df = star.transactions(spark, "/root/testdata/sf0.001")
    before = {str(p) for p in Path(shared_folder).iterdir()}
    out = features.customer_features(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan
    made = sorted(p.name.split("-")[0] for p in Path(shared_folder).iterdir() if str(p) not in before)
    # Stored: the joined lines, once; from them the orders per customer and the levels.
    assert made == ["distinct", "feature", "levels", "per"]


def test_scanned_lines_are_not_stored_again(spark, shared_folder, tmp_path):
    from tillwise.session import read_again
    from tillwise.sources import star_schema as star

    path = str(tmp_path / "lines")
    star.transactions(spark, "/root/testdata/sf0.001").write.parquet(path)
    before = {str(p) for p in Path(shared_folder).iterdir()}
    features.customer_features(spark.read.parquet(path).where("quantity > 0"))
    made = sorted(p.name.split("-")[0] for p in Path(shared_folder).iterdir() if str(p) not in before)
    assert made == ["distinct", "levels", "per"]
    df = spark.range(9)
    assert read_again(df, "x") is df
    assert "parquet" in read_again(df.groupBy("id").count(), "x")._jdf.queryExecution().optimizedPlan().toString().lower()


def test_feature_columns_and_alignment(frame):
    df = frame("customer_id string, x int, name string, ok boolean, y double", ("a", 1, "n", True, 2.0))
    assert features.select_feature_columns(df) == ["x", "ok", "y"]
    assert features.align_features(df, ["x", "z"]).first()["z"] == 0.0


def test_few_levels_are_counted_in_one_shuffle(frame, monkeypatch):
    df = frame(
        "customer_id string, channel string, device int, location string",
        ("a", "web", 1, "x"), ("a", "web", None, "y"), ("a", "shop", 2, None), ("b", None, None, None),
        ("c", "app", 2, None), (None, "fax", 3, "z"),
    )
    levels = features.category_levels(df)
    assert levels == {"channel": ["app", "fax", "shop", "web"], "device": [1, 2, 3], "location": ["x", "y", "z"]}
    wanted = {"channel": ["web", "app"], "device": [2, 9], "location": [], "payment_method": ["cash"]}
    few = features.category_shares(df, wanted)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
    monkeypatch.setattr(features, "COUNTERS", 0)
    many = features.category_shares(df, wanted)
    assert "Generate" in many._jdf.queryExecution().executedPlan().toString()
    assert few.columns == many.columns
    assert rows(few, "customer_id") == rows(many, "customer_id") == [
        ("a", 2 / 3, 0.0, 0.5, 0.0, 0.0), ("c", 0.0, 1.0, 1.0, 0.0, 0.0),
    ]


def test_features_plan_is_plain(frame):
    plan = features.customer_features(lines(frame))._jdf.queryExecution().toString()
    for word in ("BatchEvalPython", "ArrowEvalPython", "Expand", "CartesianProduct", "Window ["):
        assert word not in plan


@pytest.mark.parametrize("per_range", [1_000_000, 7])
def test_ranks_and_quantiles_equal_a_plain_sort(spark, per_range):
    draw = Random(1)
    values = [draw.choice([0.0, -0.0, 1.0, None, draw.random() * 9]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(5)
    known = sorted(v for v in values if v is not None)
    expected = {
        i: (sum(k < v for k in known) + (sum(k == v for k in known) + 1) / 2) / len(known)
        for i, v in enumerate(values)
        if v is not None
    }
    got = ranks.with_percent_rank(df, "v", "r", values_per_range=per_range).collect()
    assert len(got) == 300
    for row in got:
        assert row["r"] == pytest.approx(expected[row["id"]]) if row["v"] is not None else row["r"] is None
    wanted = {"q0": 0.0, "q1": 0.31, "q2": 0.5, "q3": 1.0}
    got = ranks.exact_quantiles(df, "v", wanted, values_per_range=per_range).first().asDict()
    for name, p in wanted.items():
        assert got[name] == pytest.approx(np.quantile(known, p))


def test_quantiles_per_group(spark):
    data = [(g, float(v)) for g in range(3) for v in range(g + 1, 40)]
    df = spark.createDataFrame(data, "g int, v double")
    got = ranks.exact_quantiles(df, "v", {"m": 0.5}, ["g"], values_per_range=5)
    expected = {g: float(np.median([v for k, v in data if k == g])) for g in range(3)}
    assert dict(rows(got)) == expected


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, same double")
    columns = ["x", "same"]
    out = segments.scale(segments.fit_scaler(df, columns), df, columns)
    out = out.select(vector_to_array("scaled"))
    got = np.array([r[0] for r in out.collect()])
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(sorted(got[:, 0]), sorted((x - x.mean()) / x.std()))
    assert np.allclose(got[:, 1], 0)


def clouds(spark):
    draw = Random(5)
    data = [
        (f"c{i}", draw.gauss(10 * (i % 3), 0.5), draw.gauss(-7 * (i % 3), 0.5), float(i % 3))
        for i in range(60)
    ]
    return spark.createDataFrame(
        data, "customer_id string, revenue_total double, orders double, recency_days double"
    )


def test_segments_find_separate_clouds(spark):
    df = clouds(spark)
    result = segments.segment_customers(df, n_clusters=3)
    got = result.customers.select("customer_id", "segment_id").collect()
    groups = {}
    for customer, segment in got:
        groups.setdefault(segment, set()).add(int(customer[1:]) % 3)
    assert len(got) == 60 and sorted(groups.values(), key=min) == [{0}, {1}, {2}]
    assert result.segment_profiles.count() == 3
    with pytest.raises(ValueError):
        segments.segment_customers(df.drop("customer_id"))


def test_kmeans_ends_by_tolerance_and_takes_numbers_only(spark):
    from tillwise.sources import star_schema as star

    df = features.customer_features(star.transactions(spark, "/root/testdata/sf0.001"))
    df = df.withColumn("is_even", F.col("orders") % 2 == 0)
    result = segments.segment_customers(df)
    assert result.model.getMaxIter() == 300 and result.model.summary.numIter < 300
    columns = [c for c in df.columns if c not in ("customer_id", "is_even")]
    assert len(result.model.clusterCenters()[0]) == len(columns)


def test_names_do_not_shuffle_customers(spark):
    df = clouds(spark).withColumn("segment_id", F.col("orders").cast("int") % 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = segments.name_segments(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_stored_customers_are_not_stored_again_to_be_named(spark, shared_folder):
    customers = segments.segment_customers(clouds(spark), n_clusters=3).customers
    before = {str(p) for p in Path(shared_folder).iterdir()}
    named = segments.name_segments(customers)
    made = [p.name for p in Path(shared_folder).iterdir() if str(p) not in before]
    assert made and not [name for name in made if name.startswith("to-name")]
    assert named.where("segment_name is null").count() == 0 and named.count() == 60


def test_level_names_may_hold_any_character(spark):
    levels = ["a.b", "c d", "e`f", "g,h"]
    df = spark.range(200).select(
        (F.col("id") % 40).cast("string").alias("customer_id"),
        F.array(*[F.lit(v) for v in levels])[(F.col("id") * F.col("id") % 4).cast("int")].alias("channel"),
        (F.col("id") % 7).cast("double").alias("total_spend"),
    )
    table = features.customer_features(df)
    assert "channel_share__a.b" in table.columns
    named = segments.name_segments(segments.segment_customers(table, n_clusters=2).customers)
    assert named.count() == 40 and decide.recommend_actions(named).count() == 40
    labels = table.select("customer_id", (F.col("customer_id") % 2).cast("int").alias("churn"))
    result = churn.train_churn_model(table, labels, features.select_feature_columns(table))
    assert churn.predict_churn_risk(result, table).where("churn_risk is not null").count() == 40


def test_silhouettes(spark):
    df = clouds(spark)
    got = dict(rows(segments.silhouette_scores(df, 2, 4)))
    assert set(got) == {2.0, 3.0, 4.0} and max(got, key=got.get) == 3.0
    few = df.limit(4)
    assert [k for k, _ in rows(segments.silhouette_scores(few, 1, 8))] == [2.0, 3.0]
    assert segments.silhouette_scores(df.limit(2)).count() == 0


def test_segment_names(frame):
    df = frame(
        "customer_id string, segment_id int, revenue_total double, orders double, recency_days double",
        ("a", 0, 1.0, 1.0, 90.0),
        ("b", 1, 50.0, 5.0, 10.0),
        ("c", 1, 70.0, 7.0, 10.0),
        ("d", 2, 10.0, 2.0, 50.0),
        ("e", 3, 20.0, 3.0, 30.0),
    )
    got = dict(rows(segments.name_segments(df).select("customer_id", "segment_name")))
    assert got == {"a": "At-Risk", "b": "Champions", "c": "Champions", "d": "Potential", "e": "Loyal"}
    only_ids = segments.name_segments(df.select("customer_id", "segment_id"))
    assert only_ids.where("customer_id = 'e'").first()["segment_name"] == "3"
    one_input = segments.name_segments(df.select("customer_id", "segment_id", "orders"))
    assert one_input.where("customer_id = 'b'").first()["segment_name"] == "Champions"
    with pytest.raises(ValueError):
        segments.name_segments(df.drop("segment_id"))


def test_forward_labels(frame):
    df = frame(
        "customer_id string, order_date timestamp_ntz, purchased int",
        ("a", at("2020-01-01"), 1),
        ("b", at("2020-01-02"), 1),
        ("c", at("2020-01-31"), 1),
        ("d", at("2020-01-31T00:00:01"), 1),
        ("e", at("2020-01-10"), 0),
    )
    ids = frame("customer_id string", *[(c,) for c in "abcdef"])
    got = dict(rows(churn.forward_churn_labels(df, at("2020-01-01"), ids, 30)))
    assert got == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1}


def test_split_takes_a_quarter_of_each_class(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("customer_id"), (F.col("id") % 10 == 0).cast("int").alias("label")
    )
    split = churn.stratified_split(df)
    assert rows(split.groupBy("label", "is_test").count(), "label", "is_test") == [
        (0, False, 675),
        (0, True, 225),
        (1, False, 75),
        (1, True, 25),
    ]
    assert rows(split, "customer_id") == rows(churn.stratified_split(df.repartition(3)), "customer_id")
    assert rows(split, "customer_id") != rows(churn.stratified_split(df, seed=1), "customer_id")


def churn_data(spark):
    draw = Random(2)
    data = []
    for i in range(400):
        x, y = draw.gauss(0, 1), draw.gauss(5, 3)
        data.append((f"c{i}", x, y, int(2 * x - 0.3 * y + draw.gauss(0, 1.5) > -1)))
    return spark.createDataFrame(data, "customer_id string, x double, y double, churn int")


def newton(x, y):
    """Minimises the balanced summed loss plus half the squared coefficients."""
    x = (x - x.mean(0)) / x.std(0)
    n = len(y)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    design = np.hstack([x, np.ones((n, 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weight * (p - y)) + penalty @ beta
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_regression_equals_an_independent_solver(spark):
    df = churn_data(spark)
    result = churn.train_churn_model_time_split(df, df.limit(100), ["x", "y"])
    data = df.toPandas()
    expected = newton(data[["x", "y"]].to_numpy(), data["churn"].to_numpy())
    got = [*result.model.coefficients.toArray(), result.model.intercept]
    assert np.allclose(got, expected, atol=2e-3)
    assert result.metadata == {"test_size": 100}


def test_model_metrics_and_scores(spark):
    df = churn_data(spark)
    labels = df.select("customer_id", "churn")
    result = churn.train_churn_model(df.drop("churn"), labels, ["x", "y", "absent"])
    assert set(result.metrics) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    assert result.metrics["roc_auc"] > 0.8
    risks = churn.predict_churn_risk(result, df.select("customer_id", "x", "y"))
    assert risks.columns == ["customer_id", "churn_risk"]
    assert risks.where("churn_risk between 0 and 1").count() == 400
    single = labels.withColumn("churn", F.lit(0))
    with pytest.raises(ValueError):
        churn.train_churn_model(df.drop("churn"), single, ["x", "y"])


def test_metrics_of_known_scores(frame):
    df = frame(
        "label int, churn_risk double",
        (1, 0.9), (1, 0.5), (1, 0.2), (0, 0.5), (0, 0.1), (0, 0.4),
    )
    got = churn.classification_metrics(df)
    assert got["accuracy"] == pytest.approx(4 / 6)
    assert got["precision"] == got["recall"] == got["f1"] == pytest.approx(2 / 3)
    # Pairs won: 3, 2.5 and 1 of 3 each.
    assert got["roc_auc"] == pytest.approx(6.5 / 9)
    one_class = churn.classification_metrics(df.where("label = 0 and churn_risk < 0.5"))
    assert one_class == {"accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_risk_reports(frame):
    df = frame("customer_id string, churn_risk double", ("a", 0.0), ("b", 1.0), ("c", None), ("d", 0.99))
    assert rows(churn.risk_histogram(df, 10)) == [(0, 1), (9, 2)]
    assert [r[0] for r in rows(churn.top_risks(df, 4))] == ["b", "d", "a", "c"]


def test_actions_and_scores(frame):
    df = frame(
        "customer_id string, churn_risk double, revenue_total double, recency_days double",
        ("retain-risk", 0.7, 1.0, 1.0),
        ("retain-days", None, 1.0, 90.0),
        ("protect", 0.4, 100.0, 1.0),
        ("upsell", 0.1, 100.0, 1.0),
        ("engage", 0.2, 2.0, 30.0),
        ("nurture", 0.2, 3.0, 31.0),
        ("unknown", None, 4.0, 1.0),
        ("no-revenue", 0.1, None, 1.0),
    )
    got = {r["customer_id"]: r for r in decide.recommend_actions(df).collect()}
    assert {k: v["recommended_action"] for k, v in got.items()} == {
        "retain-risk": decide.RETENTION,
        "retain-days": decide.RETENTION,
        "protect": decide.PROTECT,
        "upsell": decide.UPSELL,
        "engage": decide.ENGAGE,
        "nurture": decide.NURTURE,
        "unknown": decide.NURTURE,
        "no-revenue": decide.ENGAGE,
    }
    assert got["protect"]["decision_score"] == pytest.approx(0.3 + 0.5 * 6.5 / 7)
    assert got["unknown"]["decision_score"] is None and got["no-revenue"]["decision_score"] is None


def test_actions_without_the_columns(frame):
    got = decide.recommend_actions(frame("customer_id string", ("a",), ("b",))).first()
    # Everyone shares the revenue 0, which is then also the quantile.
    assert got["recommended_action"] == decide.UPSELL
    assert got["decision_score"] == pytest.approx(0.5 + 0.5 * 0.75)
    assert decide.recommend_actions(frame("customer_id string", ("a",)).limit(0)).count() == 0


def test_runs_of_threads_keep_their_own_folder(spark):
    import threading

    from tillwise.session import materialize, scratch_run

    begun, ended, seen = threading.Event(), threading.Event(), []

    def other():
        with scratch_run(spark) as folder:
            begun.set()
            ended.wait(60)
            seen.append((folder, materialize(spark.range(3), "x").inputFiles()[0]))

    thread = threading.Thread(target=other)
    thread.start()
    begun.wait(60)
    with scratch_run(spark) as mine:
        path = materialize(spark.range(3), "x").inputFiles()[0]
        assert mine in path
    ended.set()
    thread.join()
    assert seen[0][0] in seen[0][1] and seen[0][0] != mine


def test_lines_of_a_churn_run_are_joined_once(spark, monkeypatch):
    """Lines from a join: the three periods read one stored table, and risks are those of stored lines."""
    days = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(id * 13 % 400 AS INT))")
    orders = spark.range(600).select(F.col("id").alias("order_id"), (F.col("id") * 7 % 60).cast("string").alias("customer_id"), days.alias("order_date"))
    lines = spark.range(900).select(
        (F.col("id") % 600).alias("order_id"), (F.col("id") % 5 + 1.0).alias("total_spend"), (F.col("id") % 4 != 0).cast("int").alias("purchased")
    )
    joined = lines.join(orders, "order_id", "left")
    stored, plain = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, name: stored.append(name) or plain(df, name))
    run = dashboard.run_churn(joined)
    assert run.risks is not None and stored == ["recent"]
    again = dashboard.run_churn(plain(joined, "lines"))
    assert run.as_of == again.as_of and rows(run.risks, "customer_id") == rows(again.risks, "customer_id")


def test_recency_since_purchase_is_that_of_the_lines(frame):
    """Counted per customer it is what ``ensure_recency`` gives every line, with purchases and without."""
    for df in (lines(frame), lines(frame).withColumn("purchased", F.lit(0))):
        expected = features.customer_features(recency.ensure_recency(df))
        got = features.customer_features(recency.dated_lines(df), since_purchase=True, once=True)
        assert got.columns == expected.columns
        assert rows(got, "customer_id") == rows(expected, "customer_id")


def test_a_run_with_recency_per_customer_is_that_with_recency_on_lines(spark, monkeypatch):
    days = F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(id * 13 % 400 AS INT))")
    orders = spark.range(600).select(F.col("id").alias("order_id"), (F.col("id") * 7 % 60).cast("string").alias("customer_id"), days.alias("order_date"))
    bought = (F.col("id") % 4 != 0) & (F.col("id") % 60 != 7)
    typed = spark.range(900).select(
        (F.col("id") % 600).alias("order_id"), (F.col("id") % 5 + 1).alias("total_spend"), bought.cast("bigint").alias("purchased"), F.col("id").alias("stock_code")
    ).join(orders, "order_id", "left")
    expected = dashboard.run_dashboard(recency.ensure_recency(typed), n_clusters=2)
    stored, plain = [], recency.materialize
    monkeypatch.setattr(recency, "materialize", lambda df, name: stored.append(name) or plain(df, name))
    got = dashboard.run_dashboard(typed, n_clusters=2, add_recency=True)
    assert stored == [] and set(got) == set(expected)
    assert got["preview"].columns == expected["preview"].columns
    order = ["order_date", "order_id", "stock_code"]
    assert rows(got["preview"], *order) == rows(expected["preview"], *order)
    for name, columns in {"decisions": ("recommended_action", "risk"), "segments": ("recency_days", "revenue_total")}.items():
        few = [
            rows(t[name].withColumn("risk", F.round(c, 9)).select("customer_id", *columns), "customer_id")
            for t in (got, expected)
            for c in ["churn_risk" if name == "decisions" else "recency_days"]
        ]
        assert few[0] == few[1] and len(few[0]) == 60


def test_scaled_values_are_those_of_the_vectors(frame):
    df = frame("a double, b int, `c.d` double", (1.0, 3, 7.0), (2.5, 3, -1.0), (9.25, 3, 0.1))
    columns = ["a", "b", "c.d"]
    scaler = segments.fit_scaler(df, columns)
    vectors = segments.scale(scaler, df, columns).select(vector_to_array("scaled"), segments.scaled_values(scaler, columns))
    assert all(one == other for one, other in vectors.collect())
