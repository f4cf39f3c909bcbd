"""Transactions and events derived from the order tables of a star schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

TRANSACTION_COLUMNS = (
    "order_id",
    "order_date",
    "customer_id",
    "stock_code",
    "product",
    "category",
    "channel",
    "device",
    "location",
    "payment_method",
    "quantity",
    "price",
    "discount",
    "total_spend",
    "visited",
    "added_to_cart",
    "purchased",
)
# Which columns need which table besides the lines.
_FROM_ORDERS = {"order_date", "customer_id", "channel", "location", "payment_method"}
_FROM_CUSTOMER = {"location", "payment_method"}
_FROM_NATION = {"location"}
_FROM_PART = {"product", "category"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def transactions(
    spark: SparkSession, folder: str, columns: Sequence[str] = TRANSACTION_COLUMNS
) -> DataFrame:
    """One row per order line with the requested columns.

    A left join keeps the lines and finds one row at most, so a table that none of the
    columns needs is not joined at all. No join is hinted: Spark broadcasts the sides it
    measures as small and splits skewed partitions of the others.
    """
    wanted = set(columns)
    df = table(spark, folder, "lineitem")
    if wanted & _FROM_ORDERS:
        # What belongs to an order is joined to orders first, so lines are shuffled once for it.
        orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
        if wanted & _FROM_CUSTOMER:
            customer = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
            if wanted & _FROM_NATION:
                nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
                customer = customer.join(nation, "c_nationkey", "left")
            orders = orders.join(customer, "o_custkey", "left")
        df = df.join(orders, "l_orderkey", "left")
    if wanted & _FROM_PART:
        part = table(spark, folder, "part").withColumnRenamed("p_partkey", "l_partkey")
        df = df.join(part, "l_partkey", "left")

    price, percent = F.col("l_extendedprice"), F.col("l_discount")
    kept = F.col("l_returnflag") != "R"
    build = {
        "order_id": lambda: F.col("l_orderkey").cast("string"),
        "order_date": lambda: F.col("o_orderdate").cast("timestamp_ntz"),
        "customer_id": lambda: F.col("o_custkey").cast("string"),
        "stock_code": lambda: F.col("l_partkey").cast("string"),
        "product": lambda: F.col("p_name"),
        "category": lambda: F.col("p_type"),
        "channel": lambda: F.col("o_orderpriority"),
        "device": lambda: F.col("l_linestatus"),
        "location": lambda: F.col("n_name"),
        "payment_method": lambda: F.col("c_mktsegment"),
        "quantity": lambda: F.col("l_quantity"),
        "price": lambda: F.try_divide(price, F.col("l_quantity")),
        "discount": lambda: F.round(percent * 100),
        # Decimals make sums exact, so they do not depend on the order of the rows.
        "total_spend": lambda: (
            price.cast("decimal(12,2)") * (1 - percent.cast("decimal(4,2)"))
        ).cast("decimal(18,4)"),
        "visited": lambda: F.lit(1).cast("bigint"),
        "added_to_cart": lambda: (kept | (F.col("l_linestatus") == "F")).cast("bigint"),
        "purchased": lambda: kept.cast("bigint"),
    }
    return df.select(*[build[c]().alias(c) for c in columns])


def online_retail(spark: SparkSession, folder: str) -> DataFrame:
    """The same lines in the raw online-retail layout, as text and with gaps.

    Returned lines have a negative quantity, each 50th customer number and each 40th stock
    code's description is missing, and each 60th order's date is unreadable.
    """
    df = transactions(spark, folder, ("order_id", "order_date", "customer_id", "stock_code",
                                      "product", "location", "quantity", "price", "purchased"))
    number = F.col("customer_id").cast("bigint")
    return df.select(
        F.col("order_id").alias("Invoice"),
        F.when(F.col("stock_code").cast("bigint") % 40 != 0, F.col("product")).alias("Description"),
        F.col("stock_code").alias("StockCode"),
        F.when(F.col("purchased") == 1, F.col("quantity"))
        .otherwise(-F.col("quantity"))
        .cast("string")
        .alias("Quantity"),
        F.when(F.col("order_id").cast("bigint") % 60 == 0, "unknown")
        .otherwise(F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
        .alias("InvoiceDate"),
        F.col("price").cast("string").alias("Price"),
        F.when(number % 50 != 0, number.cast("double").cast("string")).alias("Customer ID"),
        F.col("location").alias("Country"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event table with its own columns."""
    return table(spark, folder, "events")


def event_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Events as funnel rows, one unit per user and day."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    return events(spark, folder).select(
        user.alias("customer_id"),
        F.concat(user, F.lit("|"), F.col("ts").cast("date").cast("string")).alias("user_day"),
        F.col("ts").cast("timestamp_ntz").alias("order_date"),
        (kind == "view").cast("bigint").alias("visited"),
        (kind == "click").cast("bigint").alias("added_to_cart"),
        (kind == "purchase").cast("bigint").alias("purchased"),
        F.when(kind == "purchase", F.col("value")).alias("total_spend"),
    )
