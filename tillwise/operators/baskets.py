"""Items bought together in one order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tillwise.functions.scalars import named
from tillwise.operators.joins import left_join_unique
from tillwise.operators.pairs import pair_counts
from tillwise.operators.windows import keep_ids
from tillwise.session import materialize

# An order of up to this many lines is one list of items.
LARGE_ORDER = 200
# Items that one task numbers.
ITEMS_PER_SLICE = 100_000


def basket_pairs(
    df: DataFrame,
    order_col: str = "order_id",
    item_col: str = "product",
    min_pair_count: int = 10,
    max_orders: int | None = None,
    max_items_per_order: int | None = None,
    large_order: int = LARGE_ORDER,
    order_by: str | None = None,
) -> DataFrame:
    """Pairs of items with the number of orders that hold both, the most frequent first.

    Every order and every item counts. ``max_orders`` and ``max_items_per_order`` are
    limits on request: the first orders by id, the first items of an order by name; with
    ``order_by``, a column of row places such as ``file_order`` of the readers, the orders and
    items that come first in it.
    """
    spark = df.sparkSession
    if order_col not in df.columns or item_col not in df.columns:
        return spark.createDataFrame([], "item_a string, item_b string, pair_count bigint")
    place = [] if order_by is None else [named(order_by).alias("place")]
    lines = df.select(named(order_col).alias("order"), named(item_col).cast("string").alias("item"), *place)
    lines = lines.dropna(subset=["order", "item"])
    # Each item of an order once, stored: everything below reads this small table.
    once = lines.groupBy("order", "item").agg(F.min("place").alias("place")) if place else lines.distinct()
    lines = materialize(once, "basket-items")
    if max_orders is not None:
        orders = lines.groupBy("order").agg(F.min("place" if place else "order").alias("first"))
        first = orders.orderBy("first", "order").limit(int(max_orders)).select("order")
        lines = keep_ids(lines, first, "order")
    if max_items_per_order is not None:
        lines = _first_items(lines, int(max_items_per_order), ("place", "item") if place else ("item",))
    least = max(0, int(min_pair_count))
    lines = _frequent(lines.select("order", "item"), least)

    sizes = materialize(lines.groupBy("order").agg(F.count(F.lit(1)).alias("items")), "order-sizes")
    big = sizes.where(F.col("items") > large_order).withColumn("is_large", F.lit(True))
    some_large = not big.isEmpty()
    if some_large:
        lines = materialize(left_join_unique(lines, big, "order", rows_per_key="items"), "marked")
    else:
        lines = lines.withColumn("is_large", F.lit(None).cast("boolean"))
    names, space = _numbered(lines)
    # An item's number, and the large orders that hold it as far as they matter.
    wanted = names.select("item", "orders", (F.col("code") * (least + 1) + F.least("large", F.lit(least))).alias("element"))
    numbered = left_join_unique(lines, wanted, "item", rows_per_key="orders", slot_by=["order"])
    numbered = numbered.select("order", "element", "is_large")

    pairs = F.col("items") * (F.col("items") - 1) / 2
    small = sizes.where(F.col("items").between(2, large_order)).select("order", "items")
    total = small.agg(F.sum(pairs)).first()[0] or 0
    if some_large:
        numbered = materialize(numbered, "numbered")
    blocks = _whole_orders(numbered.where(F.col("is_large").isNull()))
    if some_large:
        shared = numbered.where(F.col("is_large") & (F.col("element") % (least + 1) >= least))
        held = materialize(shared.groupBy("order").agg(F.count(F.lit(1)).alias("items")), "shared-sizes")
        total += held.agg(F.sum(pairs)).first()[0] or 0
        blocks = blocks.unionByName(_blocks(shared.select("order", "element"), held, large_order))
    counts = pair_counts(blocks, space, total, least, least if some_large else 0)
    if some_large:
        counts = materialize(counts, "pair-counts")
    for side in ("a", "b"):
        counts = counts.join(names.select(F.col("code").alias(side), F.col("item").alias(f"_{side}")), side)
    counts = counts.select(
        F.least("_a", "_b").alias("item_a"), F.greatest("_a", "_b").alias("item_b"), "pair_count", "spare"
    )
    if some_large:
        counts = _looked_up(materialize(counts, "pairs"), names, lines.where("is_large").select("order", "item"))
    return (
        counts.where(F.col("pair_count") >= least)
        .select("item_a", "item_b", "pair_count")
        .orderBy(F.desc("pair_count"), "item_a", "item_b")
    )


def _first_items(lines: DataFrame, limit: int, order: tuple[str, ...] = ("item",), slots: int = 64) -> DataFrame:
    """The first ``limit`` items of each order, by the columns ``order``.

    First within slots of an order, then of what is left, so that no task orders more than a
    slot of a very large order, or ``slots * limit`` items.
    """
    slot = F.pmod(F.xxhash64("item"), F.lit(slots))
    for keys in (["order", slot], ["order"]):
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        lines = lines.withColumn("number", number).where(F.col("number") <= limit).drop("number")
    return lines


def _frequent(lines: DataFrame, min_pair_count: int) -> DataFrame:
    """Without the items of too few orders: a pair is no more frequent than its rarer item.

    Items to leave out are in few lines, so looking them up is no burden for any task, and
    where there are none, nothing is looked up.
    """
    support = lines.groupBy("item").agg(F.count(F.lit(1)).alias("orders"))
    rare = materialize(support.where(F.col("orders") < min_pair_count).select("item"), "rare-items")
    return lines if rare.isEmpty() else materialize(lines.join(rare, "item", "left_anti"), "frequent-items")


def _numbered(lines: DataFrame) -> tuple[DataFrame, int]:
    """Per item its ``orders``, those of them that are ``large``, and its number ``code``; and what is above all numbers.

    Items are counted off within slices of their hash, so no task numbers more than a slice.
    """
    marked = F.coalesce("is_large", F.lit(False))
    items = lines.groupBy("item").agg(F.count(F.lit(1)).alias("orders"), F.count_if(marked).alias("large"))
    items = materialize(items, "items")
    slices = max(1, math.ceil(items.count() / ITEMS_PER_SLICE))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("item"))
    code = (place - 1).cast("bigint") * slices + F.col("slice")
    names = items.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(slices))).withColumn("code", code).drop("slice")
    names = materialize(names, "item-numbers")
    return names, (names.agg(F.max("code")).first()[0] or 0) + 1


def _whole_orders(lines: DataFrame) -> DataFrame:
    """Orders as lists of items, all pairs of which count."""
    orders = lines.groupBy("order").agg(F.collect_list("element").alias("left"))
    return orders.where(F.size("left") > 1).select("left", F.lit(None).cast("array<bigint>").alias("right"))


def _blocks(lines: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Orders cut into blocks of about ``block`` items, as pairs of blocks.

    Two blocks are lists whose pairs count crosswise; a block with itself has no ``right``. Each
    pair of blocks is one key, so the work on one order spreads over many tasks.
    """
    blocks = F.ceil(F.col("items") / block).cast("int")
    placed = left_join_unique(
        lines,
        sizes.select("order", blocks.alias("blocks"), "items"),
        "order",
        rows_per_key="items",
    ).withColumn("mine", F.pmod(F.xxhash64("element"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = placed.select("order", "element", "mine", F.explode(every).alias("other")).select(
        "order",
        "element",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("is_left"),
    )
    both = cells.groupBy("order", "i", "j").agg(
        F.collect_list(F.when(F.col("is_left"), F.col("element"))).alias("left"),
        F.collect_list(F.when(~F.col("is_left"), F.col("element"))).alias("right"),
    )
    right = F.when(F.col("i") < F.col("j"), F.col("right"))
    return both.select("left", right.alias("right"))


def _looked_up(counts: DataFrame, names: DataFrame, large: DataFrame) -> DataFrame:
    """``counts`` with what large orders add to pairs that have something to ``spare``.

    An item is *common* if enough large orders hold it to lift a pair over the threshold
    by themselves; pairs of two common items are counted already. Any other pair stays below the
    threshold within the large orders, so it matters only if an ordinary order has it too,
    and only if its count there plus the large orders of its rarer item (``spare``) could reach
    the threshold. Such pairs are looked up: the orders of the rarer item are joined, and then
    the other item in these orders. No list of orders is gathered, whatever the threshold.
    """
    open_ = counts.where(F.col("spare") > 0)
    for side in ("a", "b"):
        weights = names.select(F.col("item").alias(f"item_{side}"), F.col("large").alias(f"large_{side}"))
        open_ = open_.join(weights, f"item_{side}")
    a, b = F.col("large_a"), F.col("large_b")
    open_ = open_.select(
        "item_a",
        "item_b",
        F.when(a <= b, F.col("item_a")).otherwise(F.col("item_b")).alias("item"),
        F.when(a <= b, F.col("item_b")).otherwise(F.col("item_a")).alias("other"),
    )
    in_orders = materialize(open_.join(large, "item").select("item_a", "item_b", "order", F.col("other").alias("item")), "lookups")
    looked_up = (
        in_orders.join(large, ["order", "item"], "left_semi")
        .groupBy("item_a", "item_b")
        .agg(F.count(F.lit(1)).alias("pair_count"))
    )
    return (
        counts.select("item_a", "item_b", "pair_count")
        .unionByName(looked_up)
        .groupBy("item_a", "item_b")
        .agg(F.sum("pair_count").alias("pair_count"))
    )
