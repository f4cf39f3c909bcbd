from collections import Counter
from datetime import date
from itertools import combinations, product
from random import Random

from conftest import at, rows
from pyspark.sql import functions as F

import pytest

from tillwise.operators import baskets, funnel, joins, market, pairs


def test_summaries_depend_on_the_columns(frame):
    df = frame(
        "category string, total_spend double, channel string",
        ("x", 1.0, "web"),
        ("x", None, None),
        ("y", 5.0, None),
        (None, 9.0, "web"),
    )
    out = market.market_research_summary(df)
    assert set(out) == {"revenue_by_category", "orders_by_channel"}
    assert rows(out["revenue_by_category"]) == [("y", 5.0), ("x", 1.0)]
    assert rows(out["orders_by_channel"]) == [("web", 2), (None, 2)]


def test_top_entities(frame):
    df = frame("p string, v string", ("a", "1"), ("b", "3"), ("c", "oops"), ("a", "2"))
    assert rows(market.top_entities(df, "p", "v", 2)) == [("a", 3.0), ("b", 3.0)]
    assert market.top_entities(df, "p", "none").count() == 0


def test_periods_without_sales_show_zero(frame):
    df = frame(
        "order_date timestamp_ntz, total_spend double",
        (at("2020-01-31T23:00"), 1.0),
        (at("2020-04-01"), None),
        (at("2020-03-15"), 2.0),
        (None, 7.0),
    )
    assert rows(market.revenue_over_time(df, freq="M")) == [
        (date(2020, 1, 31), 1.0),
        (date(2020, 2, 29), 0.0),
        (date(2020, 3, 31), 2.0),
        (date(2020, 4, 30), 0.0),
    ]
    assert rows(market.revenue_over_time(df, freq="QE")) == [
        (date(2020, 3, 31), 3.0),
        (date(2020, 6, 30), 0.0),
    ]
    assert rows(market.revenue_over_time(df, freq="YE")) == [(date(2020, 12, 31), 3.0)]
    assert rows(market.revenue_over_time(df, freq="MS"))[0] == (date(2020, 1, 1), 1.0)
    weeks = rows(market.revenue_over_time(df, freq="W"))
    assert weeks[0] == (date(2020, 2, 2), 1.0) and len(weeks) == 10
    assert market.revenue_over_time(df, freq="D").count() == 62
    assert market.revenue_over_time(df.limit(0)).count() == 0
    assert market.revenue_over_time(df.drop("total_spend")).columns == ["order_date", "revenue"]
    for bad in ("fortnight", "0h", "h2"):
        with pytest.raises(ValueError):
            market.revenue_over_time(df, freq=bad)


def test_business_days_and_fixed_lengths(frame):
    df = frame(
        "order_date timestamp_ntz, total_spend double",
        (at("2024-03-01T09:10"), 1.0),  # a Friday
        (at("2024-03-02T23:59:59"), 2.0),
        (at("2024-03-03"), 4.0),
        (at("2024-03-05T01:00"), 8.0),
    )
    assert rows(market.revenue_over_time(df, freq="B")) == [
        (date(2024, 3, 1), 7.0),
        (date(2024, 3, 4), 0.0),
        (date(2024, 3, 5), 8.0),
    ]
    hours = rows(market.revenue_over_time(df, freq="h"))
    assert hours[0] == (at("2024-03-01T09:00"), 1.0) and hours[-1] == (at("2024-03-05T01:00"), 8.0)
    assert len(hours) == 89 and sum(v for _, v in hours) == 15.0
    assert rows(market.revenue_over_time(df, freq="2D")) == [
        (at("2024-03-01"), 3.0),
        (at("2024-03-03"), 4.0),
        (at("2024-03-05"), 8.0),
    ]
    assert rows(market.revenue_over_time(df, freq="45min"))[0] == (at("2024-03-01T09:00"), 1.0)
    assert market.revenue_over_time(df.limit(0), freq="h").count() == 0


def brute_force_pairs(lines, least):
    orders = {}
    for order, item in lines:
        if order is not None and item is not None:
            orders.setdefault(order, set()).add(item)
    pairs = Counter(p for items in orders.values() for p in combinations(sorted(items), 2))
    return sorted((a, b, n) for (a, b), n in pairs.items() if n >= least)


@pytest.mark.parametrize("least", [1, 2, 4])
def test_basket_pairs_with_large_orders(frame, least):
    """Orders above the limit take another way; the counts must not differ."""
    draw = Random(3)
    items = [f"item{i:02d}" for i in range(30)]
    lines = [(f"o{o}", draw.choice(items)) for o in range(25) for _ in range(draw.randint(1, 5))]
    lines += [(f"big{o}", i) for o in range(3) for i in draw.sample(items, 20)]
    lines += [("hot", i) for i in items for _ in range(4)] + [("o1", None), (None, "item01")]
    df = frame("order_id string, product string", *lines)
    expected = brute_force_pairs(lines, least)
    assert sorted(rows(baskets.basket_pairs(df, min_pair_count=least, large_order=6))) == expected
    assert sorted(rows(baskets.basket_pairs(df, min_pair_count=least))) == expected


@pytest.mark.parametrize("least", [150, 260, 400])
def test_basket_pairs_of_high_support_in_large_orders(spark, least):
    """Thresholds in the hundreds, most of the support in orders above the limit."""
    draw = Random(7)
    items = [f"item{i:02d}" for i in range(24)]
    lines = [(f"big{o}", i) for o in range(400) for i in draw.sample(items, 8 + o % 14)]
    lines += [(f"o{o}", i) for o in range(300) for i in draw.sample(items[:6], 3)]
    df = spark.createDataFrame(lines, "order_id string, product string")
    got = baskets.basket_pairs(df, min_pair_count=least, large_order=7)
    assert sorted(rows(got)) == brute_force_pairs(lines, least)


def test_pairs_are_shuffled_in_few_bytes(spark, monkeypatch):
    """Nearly all pairs are below the threshold, and some orders above the limit: no table holds all pairs."""
    monkeypatch.setattr(pairs, "PER_PART", 10_000)
    monkeypatch.setattr(pairs, "AT_ONCE", 4_096)
    draw = Random(11)
    lines = [(f"o{o}", f"item{draw.randrange(2000):05d}") for o in range(300) for _ in range(40 + o % 8 // 7 * 25)]
    df = spark.createDataFrame(lines, "order_id string, product string").repartition(3)
    stored = []
    plain = baskets.materialize
    monkeypatch.setattr(baskets, "materialize", lambda df, name: stored.append(plain(df, name)) or stored[-1])
    got = sorted(rows(baskets.basket_pairs(df, min_pair_count=2, large_order=45)))
    assert got == brute_force_pairs(lines, 2) and len(got) > 1000
    every = len(brute_force_pairs(lines, 1))
    assert every > 150_000 and max(table.count() for table in stored) < every / 2


@pytest.mark.parametrize("most", [0, 3])
def test_packed_pairs_of_lists_and_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(pairs, "AT_ONCE", 64)
    draw = Random(5)
    reserve = {c: draw.randint(0, most) for c in range(50)}
    entry = lambda c: c * 4 + reserve[c]
    lists, expected = [], Counter()
    for n in range(200):
        items = draw.sample(range(50), draw.randint(0, 9))
        left, right = (items, None) if n % 2 else (items[::2], items[1::2])
        lists.append(([entry(c) for c in left], right and [entry(c) for c in right]))
        if n % 2 == 0 and not right:
            lists[-1] = (lists[-1][0], [])
        expected.update(tuple(sorted(p)) for p in (combinations(left, 2) if right is None else product(left, right)))
    df = spark.createDataFrame(lists, "left array<bigint>, right array<bigint>").repartition(3)
    spared = {p: m if (m := min(reserve[p[0]], reserve[p[1]])) < 3 else 0 for p in expected}
    wanted = {(*p, n, spared[p]) for p, n in expected.items() if n + spared[p] >= 3}
    for total in (10, 2e8):
        assert set(rows(pairs.pair_counts(df, 50, total, 3, most))) == wanted


def test_first_items_of_a_large_order(spark):
    df = spark.range(20_000).select(F.lit("o").alias("order"), F.format_string("i%05d", F.col("id")).alias("item"))
    got = [r["item"] for r in baskets._first_items(df, 5).orderBy("item").collect()]
    assert got == [f"i{k:05d}" for k in range(5)]


def test_basket_limits_on_request(frame):
    lines = [("o1", "a"), ("o1", "b"), ("o1", "c"), ("o2", "a"), ("o2", "b"), ("o3", "a"), ("o3", "b")]
    df = frame("order_id string, product string", *lines)
    assert rows(baskets.basket_pairs(df, min_pair_count=1)) == [
        ("a", "b", 3),
        ("a", "c", 1),
        ("b", "c", 1),
    ]
    limited = baskets.basket_pairs(df, min_pair_count=1, max_orders=2, max_items_per_order=2)
    assert rows(limited) == [("a", "b", 2)]
    assert baskets.basket_pairs(df.drop("product")).count() == 0
    assert baskets.basket_pairs(df.limit(0)).count() == 0


def test_basket_pairs_need_no_cross_join(frame):
    df = frame("order_id string, product string", *[(f"o{i % 3}", f"i{i}") for i in range(30)])
    for limit in (200, 4):
        plan = baskets.basket_pairs(df, min_pair_count=1, large_order=limit)
        text = plan._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_funnel_counts_and_rates(frame):
    df = frame(
        "order_id string, channel string, visited string, added_to_cart int, purchased int",
        ("o1", "web", "1", 1, 1),
        ("o1", "web", "1", 0, 0),
        ("o2", "web", "bad", 1, 0),
        ("o3", None, "1", 0, 0),
        (None, "app", "1", 1, 1),
    )
    total = funnel.compute_funnel(df).first().asDict()
    assert (total["visited_count"], total["added_to_cart_count"], total["purchased_count"]) == (4, 3, 2)
    assert total["visit_to_cart_rate"] == 0.75 and total["cart_to_purchase_rate"] == 2 / 3
    by_order = funnel.compute_funnel(df, unit_col="order_id").first()
    assert tuple(by_order)[:3] == (2, 2, 1)
    grouped = rows(funnel.compute_funnel(df, "channel", unit_col="order_id"))
    assert grouped == [("web", 1, 2, 1, 2.0, 0.5, 1.0)]
    assert rows(funnel.compute_funnel(df, "unknown")) == [tuple(total.values())]
    nothing = funnel.compute_funnel(df.limit(0)).first()
    assert tuple(nothing) == (0, 0, 0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        funnel.compute_funnel(df, funnel_cols=("visited", "purchased"))


def test_bottleneck(frame):
    schema = "channel string, visit_to_cart_rate double, cart_to_purchase_rate double"
    df = frame(schema, ("b", 0.9, 0.1), ("a", 0.1, 0.9))
    assert funnel.bottleneck_stage(df) == "visit_to_cart"
    assert funnel.bottleneck_stage(df.where("channel = 'b'")) == "cart_to_purchase"
    assert funnel.bottleneck_stage(df.limit(0)) == "unknown"


def test_funnel_counts_from_events(frame):
    df = frame("order_id string, visited int", ("o1", 9), ("o2", 9), ("o3", 9), (None, 9))
    events = frame(
        "order_id string, event_type string",
        *[("o1", "view")] * 3, ("o1", "click"), ("o2", "click"), ("o2", "click"), ("o4", "view"),
    )
    out = funnel.attach_funnel_counts(df, events)
    assert out.columns == ["order_id", "visited", "added_to_cart", "purchased"]
    assert rows(out, F.asc_nulls_last("order_id")) == [
        ("o1", 3, 1, 1),
        ("o2", 2, 2, 1),
        ("o3", 1, 1, 1),
        (None, 0, 0, 1),
    ]


@pytest.mark.parametrize("counted", [True, False])
def test_join_spreads_hot_and_missing_keys(spark, counted):
    left = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 997))
        .alias("key"),
        F.lit(1).alias("same"),
    )
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).dropna()
    right = right.withColumn("value", F.concat(F.lit("v-"), "key"))
    if counted:
        out = joins.left_join_unique(left, right, "key", rows_per_key="lines", hot_rows=10)
    else:
        out = joins.left_join_unique(left, right.drop("lines"), "key", hot_rows=10)
    assert out.columns == ["key", "same", "value"]
    assert out.count() == 6000
    assert out.where("value is distinct from concat('v-', key)").count() == 0
    assert out.where("key is null").count() == 2000


@pytest.mark.parametrize("common", ["hot", None])
def test_rows_of_one_key_reach_many_tasks(spark, common):
    left = spark.range(0, 8000, 1, 8).select(
        F.when(F.col("id") % 3 < 2, common).otherwise(F.col("id").cast("string")).alias("key")
    )
    right = left.dropna().groupBy("key").agg(F.count(F.lit(1)).alias("lines"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = joins.left_join_unique(left, right, "key", rows_per_key="lines", hot_rows=10)
        placed = out.select("key", F.spark_partition_id().alias("task"))
        tasks = placed.where(F.col("key").eqNullSafe(common)).select("task").distinct()
        # These rows are copies, so each of the 8 source tasks sends its own to one slot.
        assert tasks.count() >= 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
