"""Registered queries: each a Spark function and, where SQL can say it, the same in SQL.

The Spark side calls the library on the supplied tables. The SQL side states the expected
result on its own terms and runs on the same tables elsewhere. Sums of money are decimal on
both sides; other floating-point results that two engines may round differently are rounded.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tillwise.functions.scalars import elapsed_days, log1p_or_zero, safe_divide, shift_days
from tillwise.operators import (
    baskets,
    churn,
    clean,
    decide,
    features,
    funnel,
    market,
    ranks,
    recency,
    segments,
    silhouette,
    windows,
)
from tillwise.plans import dashboard
from tillwise.session import materialize, shared_scratch
from tillwise.sources import readers, star_schema as star, workbook

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


# --- shared SQL ---------------------------------------------------------------------

TX = """tx AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_date,
         CAST(o_custkey AS VARCHAR) AS customer_id, CAST(l_partkey AS VARCHAR) AS stock_code,
         p_name AS product, p_type AS category, o_orderpriority AS channel,
         l_linestatus AS device, n_name AS location, c_mktsegment AS payment_method,
         l_quantity AS quantity,
         CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price,
         round(l_discount * 100) AS discount,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS total_spend,
         CAST(1 AS BIGINT) AS visited,
         CAST(CASE WHEN l_returnflag <> 'R' OR l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT)
           AS added_to_cart,
         CAST(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS BIGINT) AS purchased
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
       LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN part ON l_partkey = p_partkey)"""


def days(later: str, earlier: str) -> str:
    return f"floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


def with_tx(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([TX, *more]) + "\n" + body


# Per customer: last purchase and days since, counted from the newest row.
RECENCY = f"""rec AS (
  SELECT customer_id, last_purchase_date,
         CAST({days('newest', 'last_purchase_date')} AS DOUBLE) AS recency_days
  FROM (SELECT customer_id,
               max(CASE WHEN purchased = 1 THEN order_date END) AS last_purchase_date
        FROM tx WHERE order_date IS NOT NULL AND customer_id IS NOT NULL GROUP BY customer_id),
       (SELECT max(order_date) AS newest FROM tx))"""

# Whole-table features without the category shares.
FEAT_COLUMNS = f"""
         CAST(count(DISTINCT order_id) AS DOUBLE) AS orders,
         CAST(sum(visited) AS DOUBLE) AS visits,
         CAST(sum(added_to_cart) AS DOUBLE) AS added_to_cart,
         CAST(count(DISTINCT CASE WHEN purchased = 1 THEN order_id END) AS DOUBLE) AS purchases,
         CAST(sum(total_spend) AS DOUBLE) AS revenue_total,
         CAST(sum(total_spend) AS DOUBLE) / count(DISTINCT order_id) AS avg_order_value,
         sum(discount) / count(discount) AS avg_discount"""
RATES = """added_to_cart / visits AS cart_rate, purchases / visits AS purchase_rate,
       CASE WHEN added_to_cart = 0 THEN 0.0 ELSE purchases / added_to_cart END
         AS cart_to_purchase_rate,
       round(ln(1 + revenue_total), 9) AS revenue_total_log1p,
       round(ln(1 + avg_order_value), 9) AS avg_order_value_log1p"""
FEAT = f"""feat AS (
  SELECT customer_id, {FEAT_COLUMNS},
         CAST({days('(SELECT max(order_date) FROM tx)', 'max(order_date)')} AS DOUBLE)
           AS recency_days
  FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)"""

# The category levels that occur in the tables.
LEVELS = {
    "channel": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "device": ["F", "O"],
    "location": sorted(f"NATION_{i}" for i in range(25)),
    "payment_method": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "category": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
}
SHARES = ",\n         ".join(
    f"coalesce(count(*) FILTER (WHERE {c} = '{v}') / nullif(count({c}), 0), 0.0)"
    f' AS "{c}_share__{v}"'
    for c, values in LEVELS.items()
    for v in values
)

# A risk and a segment that follow from the customer number, in place of a model's.
RISK = "CASE WHEN CAST(customer_id AS BIGINT) % 11 <> 0 THEN (CAST(customer_id AS BIGINT) * 37 % 101) / 100.0 END"
SCORED = f"""scored AS (
  SELECT *, CAST({RISK} AS DOUBLE) AS churn_risk,
         CAST(CAST(customer_id AS BIGINT) % 5 AS INTEGER) AS segment_id FROM feat)"""


def scored_features(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("customer_id").cast("bigint")
    return base_features(spark, folder).withColumns(
        {
            "churn_risk": F.when(number % 11 != 0, (number * 37 % 101) / 100),
            "segment_id": (number % 5).cast("int"),
        }
    )


BASE_COLUMNS = (
    "customer_id",
    "order_id",
    "order_date",
    "visited",
    "added_to_cart",
    "purchased",
    "total_spend",
    "discount",
)


def base_features(spark: SparkSession, folder: str) -> DataFrame:
    return features.customer_features(star.transactions(spark, folder, BASE_COLUMNS))


# --- sources and sinks --------------------------------------------------------------


def unclean(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as text, some dates, quantities and flags unreadable."""
    df = star.transactions(
        spark,
        folder,
        ("order_id", "order_date", "customer_id", "stock_code", "quantity", "total_spend",
         "visited", "purchased"),
    )
    order, stock = F.col("order_id").cast("bigint"), F.col("stock_code").cast("bigint")
    return df.select(
        "order_id",
        F.when(order % 97 == 0, "no date")
        .otherwise(F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
        .alias("order_date"),
        "customer_id",
        "stock_code",
        F.when(stock % 53 == 0, "n/a").otherwise(F.col("quantity").cast("string")).alias("quantity"),
        F.when(stock % 31 == 0, "12.5d").otherwise(F.col("total_spend").cast("string"))
        .alias("total_spend"),
        F.lit("1.9").alias("visited"),
        F.when(stock % 7 == 0, "x").otherwise(F.col("purchased").cast("string")).alias("purchased"),
    )


UNCLEAN_LINES = """raw AS (
  SELECT order_id, customer_id, stock_code,
         CASE WHEN CAST(order_id AS BIGINT) % 97 <> 0 THEN order_date END AS order_date,
         CASE WHEN CAST(stock_code AS BIGINT) % 53 <> 0 THEN quantity END AS quantity,
         CASE WHEN CAST(stock_code AS BIGINT) % 31 <> 0 THEN CAST(total_spend AS DOUBLE) END
           AS total_spend,
         CAST(1 AS BIGINT) AS visited,
         CASE WHEN CAST(stock_code AS BIGINT) % 7 <> 0 THEN purchased ELSE 0 END AS purchased
  FROM tx)"""
UNCLEAN_SQL = with_tx(
    f"""SELECT order_id, order_date, r.customer_id, stock_code, quantity, total_spend, visited,
       purchased, last_purchase_date,
       CAST({days('newest', 'last_purchase_date')} AS DOUBLE) AS recency_days
FROM raw r LEFT JOIN (
       SELECT customer_id, max(order_date) AS last_purchase_date FROM raw
       WHERE order_date IS NOT NULL AND purchased = 1 GROUP BY customer_id) p
     ON r.customer_id = p.customer_id
     CROSS JOIN (SELECT max(order_date) AS newest FROM raw)
WHERE order_date IS NOT NULL""",
    UNCLEAN_LINES,
)


@query("coerce_transactions", UNCLEAN_SQL)
def _(spark, folder):
    return clean.coerce_transactions(unclean(spark, folder))


@query("load_transactions_csv", UNCLEAN_SQL)
def _(spark, folder):
    path = readers.write_table(unclean(spark, folder), shared_scratch(spark, "tx") + ".csv", "csv")
    return readers.load_transactions(spark, path)


RETAIL = """raw AS (
  SELECT order_id, stock_code, coalesce(location, 'nan') AS location, price,
         CASE WHEN CAST(customer_id AS BIGINT) % 50 <> 0 THEN customer_id END AS customer_id,
         CASE WHEN CAST(stock_code AS BIGINT) % 40 <> 0 AND product IS NOT NULL THEN product
              ELSE 'nan' END AS product,
         CASE WHEN purchased = 1 THEN quantity ELSE -quantity END AS quantity,
         CASE WHEN CAST(order_id AS BIGINT) % 60 <> 0 THEN order_date END AS order_date
  FROM tx)"""


def retail_sql(keep: str, churn_column: str = "") -> str:
    return with_tx(
        f"""SELECT order_id, order_date, k.customer_id, stock_code, product, quantity,
       price, location, coalesce(quantity, 0) * coalesce(price, 0) AS total_spend,
       CAST(0 AS BIGINT) AS visited, CAST(0 AS BIGINT) AS added_to_cart,
       CAST(1 AS BIGINT) AS purchased, CAST(0.0 AS DOUBLE) AS discount,
       last_purchase_date,
       CAST({days('newest', 'last_purchase_date')} AS DOUBLE) AS recency_days{churn_column}
FROM kept k JOIN (SELECT customer_id, max(order_date) AS last_purchase_date
                  FROM kept GROUP BY customer_id) p ON k.customer_id = p.customer_id
     CROSS JOIN (SELECT max(order_date) AS newest FROM kept)""",
        RETAIL,
        f"""kept AS (SELECT * FROM raw WHERE order_date IS NOT NULL
           AND customer_id IS NOT NULL AND {keep})""",
    )


RETAIL_SQL = retail_sql("quantity > 0 AND price > 0")


@query("normalize_online_retail", RETAIL_SQL)
def _(spark, folder):
    return clean.normalize_online_retail(star.online_retail(spark, folder))


@query(
    "normalize_online_retail_with_returns_and_churn",
    retail_sql(
        "true",
        f""", CAST(CASE WHEN {days('newest', 'last_purchase_date')} >= 60 THEN 1 ELSE 0 END
             AS INTEGER) AS churn""",
    ),
)
def _(spark, folder):
    raw = star.online_retail(spark, folder)
    return clean.normalize_online_retail(
        raw, include_returns=True, add_churn=True, churn_threshold_days=60
    )


@query("load_online_retail_other_dates", RETAIL_SQL)
def _(spark, folder):
    """Dates written month first, in a file whose text needs quotes; the shape is found out."""
    raw = star.online_retail(spark, folder)
    moment = F.try_to_timestamp("InvoiceDate", F.lit("yyyy-MM-dd HH:mm:ss"))
    dates = F.coalesce(F.date_format(moment, "M/d/yyyy H:mm"), F.col("InvoiceDate"))
    path = readers.write_table(raw.withColumn("InvoiceDate", dates), shared_scratch(spark, "us"), "csv")
    return readers.load_online_retail(spark, path, kind="csv")


QUOTED_SQL = with_tx(
    """SELECT order_id, stock_code, '12" ' || product || ', "new"' || chr(10) || '\\ end ' AS product,
       CAST(order_date AS TIMESTAMP) AS order_date FROM tx WHERE order_date IS NOT NULL"""
)


@query("load_csv_with_quotes_and_line_breaks", QUOTED_SQL)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "stock_code", "product", "order_date"))
    odd = F.concat(F.lit('12" '), "product", F.lit(', "new"\n\\ end '))
    path = readers.write_table(df.withColumn("product", odd), shared_scratch(spark, "quoted"), "csv")
    loaded = readers.load_dataset(spark, path, kind="csv", multi_line=True)
    return loaded.select("order_id", "stock_code", "product", "order_date")


@query("load_online_retail", RETAIL_SQL)
def _(spark, folder):
    path = readers.write_table(star.online_retail(spark, folder), shared_scratch(spark, "retail"))
    return readers.load_online_retail(spark, path)


# The least parts of a workbook; style 1 shows dates.
BOOK_PARTS = {
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Other" r:id="r2"/><sheet name="Lines" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="m/d/yyyy\\ h:mm"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData><row><c t='inlineStr'><is><t>nothing</t></is></c></row></sheetData></worksheet>",
}


def packed_workbook(names: list[str], rows: list[tuple]) -> bytes:
    """A workbook of rows of text: numbers and moments as such, texts as shared strings."""
    return packed_columns(names, [pa.array(column, pa.string()) for column in zip(*rows)])


def packed_columns(names: list[str], columns: list[pa.Array]) -> bytes:
    """``packed_workbook`` of the columns of rows."""
    strings: dict[str, int] = {}

    def cell(value: str | None) -> str:
        if value is None:
            return "<c/>"
        try:
            return f"<c><v>{float(value)!r}</v></c>"
        except ValueError:
            pass
        try:
            days = (datetime.fromisoformat(value) - datetime(1899, 12, 30)) / timedelta(days=1)
            return f'<c s="1"><v>{days!r}</v></c>'
        except ValueError:
            return f'<c t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'

    def cells(column: pa.Array) -> pa.Array:
        # Texts of numbers are written as they are, other values that come again are written out once.
        number = pc.match_substring_regex(column, r"^-?[0-9]+(\.[0-9]+)?([eE]-?[0-9]+)?$")
        found = pc.if_else(number, None, column).dictionary_encode()
        texts = pa.array(map(cell, found.dictionary.to_pylist()), pa.large_string()).take(found.indices)
        numbers = pc.binary_join_element_wise(large("<c><v>"), column.cast(pa.large_string()), large("</v></c>"), large(""))
        return pc.fill_null(pc.if_else(number, numbers, texts), cell(None))

    large = lambda text: pa.scalar(text, pa.large_string())
    header = f"<row>{''.join(map(cell, names))}</row>"
    body = b""
    if columns and len(columns[0]):
        lines = pc.binary_join_element_wise(large("<row>"), *map(cells, columns), large("</row>"), large(""))
        body = memoryview(lines.buffers()[2])[: pc.sum(pc.binary_length(lines)).as_py()]
    shared = "".join(f"<si><t>{escape(text)}</t></si>" for text in strings)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        for path, part in BOOK_PARTS.items():
            book.writestr(path, part)
        book.writestr("xl/sharedStrings.xml", f"<sst>{shared}</sst>")
        sheet = [f"<worksheet><sheetData>{header}".encode(), body, b"</sheetData></worksheet>"]
        book.writestr("xl/worksheets/sheet1.xml", b"".join(sheet))
    return out.getvalue()


def packed_workbooks(df: DataFrame) -> DataFrame:
    """The rows of ``df``, all text, as workbooks in a column ``content``; each batch is one."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                book = packed_columns(batch.schema.names, batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([book], pa.binary())], names=["content"])

    return df.mapInArrow(pack, "content binary")


@query("load_online_retail_workbooks", RETAIL_SQL)
def _(spark, folder):
    books = materialize(packed_workbooks(star.online_retail(spark, folder)), "workbooks")
    return clean.normalize_online_retail(workbook.sheet_table(books, "Lines"))


@query("load_dataset_by_layout", RETAIL_SQL)
def _(spark, folder):
    target = shared_scratch(spark, "retail") + ".csv"
    path = readers.write_table(star.online_retail(spark, folder), target, "csv")
    return readers.load_dataset(spark, path)


@query(
    "load_uploaded_rename_only",
    with_tx(
        """SELECT order_id, order_date, customer_id, location, price AS total_spend
FROM raw WHERE order_date IS NOT NULL""",
        """raw AS (
  SELECT order_id, location, price,
         CASE WHEN CAST(customer_id AS BIGINT) % 50 <> 0 THEN customer_id || '.0' END
           AS customer_id,
         CASE WHEN CAST(order_id AS BIGINT) % 60 <> 0 THEN order_date END AS order_date
  FROM tx)""",
    ),
)
def _(spark, folder):
    path = readers.write_table(star.online_retail(spark, folder), shared_scratch(spark, "upload"))
    loaded = readers.load_uploaded(spark, path, rename_only=True)
    return loaded.select("order_id", "order_date", "customer_id", "location", "total_spend")


@query(
    "parquet_round_trip",
    with_tx(
        """SELECT order_id, order_date, customer_id, stock_code, product, category, quantity,
       CAST(total_spend AS DOUBLE) AS total_spend, purchased FROM tx"""
    ),
)
def _(spark, folder):
    names = ("order_id", "order_date", "customer_id", "stock_code", "product", "category",
             "quantity", "total_spend", "purchased")
    df = star.transactions(spark, folder, names)
    path = readers.write_table(df, shared_scratch(spark, "lines"), partition_by=("category",))
    stored = spark.read.parquet(path).select(*names)
    return stored.withColumn("total_spend", F.col("total_spend").cast("double"))


PREVIEW = ("order_id", "order_date", "customer_id", "stock_code", "quantity", "discount",
           "total_spend", "purchased")


@query(
    "preview_rows",
    with_tx(
        f"""SELECT {', '.join(PREVIEW)} FROM (
  SELECT {', '.join(c if c != 'total_spend' else 'CAST(total_spend AS DOUBLE) AS total_spend'
                    for c in PREVIEW)} FROM tx)
ORDER BY order_date, order_id, stock_code, quantity, discount, total_spend, purchased
LIMIT 1000"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, PREVIEW)
    order = ["order_date", "order_id", "stock_code", "quantity", "discount", "total_spend",
             "purchased"]
    return windows.preview(df, order).withColumn("total_spend", F.col("total_spend").cast("double"))


# --- cleaning and labels ------------------------------------------------------------


@query(
    "line_revenue",
    with_tx(
        """SELECT order_id, stock_code, quantity, discount,
       round(price * quantity * (1 - discount / 100), 4) AS total_spend FROM tx"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "stock_code", "quantity", "discount", "price"))
    return rounded(clean.line_revenue(df), 4, "total_spend").drop("price")


def churn_sql(comparison: str) -> str:
    return with_tx(
        f"""SELECT tx.customer_id, order_id, order_date, purchased, last_purchase_date, recency_days,
       CAST(CASE WHEN coalesce(recency_days, 0) {comparison} THEN 1 ELSE 0 END AS INTEGER) AS churn
FROM tx LEFT JOIN rec ON tx.customer_id = rec.customer_id WHERE order_date IS NOT NULL""",
        RECENCY,
    )


LABEL_COLUMNS = ("customer_id", "order_id", "order_date", "purchased")


@query("churn_label", churn_sql(">= 90"))
def _(spark, folder):
    return clean.add_churn_label(star.transactions(spark, folder, LABEL_COLUMNS))


@query("churn_label_strict", churn_sql("> 90"))
def _(spark, folder):
    df = star.transactions(spark, folder, LABEL_COLUMNS)
    return clean.add_churn_label(df, inclusive=False)


@query(
    "recency_on_lines",
    with_tx(
        """SELECT tx.customer_id, order_id, order_date, purchased, last_purchase_date, recency_days
FROM tx LEFT JOIN rec ON tx.customer_id = rec.customer_id WHERE order_date IS NOT NULL""",
        RECENCY,
    ),
)
def _(spark, folder):
    return recency.ensure_recency(star.transactions(spark, folder, LABEL_COLUMNS))


@query(
    "customer_recency",
    with_tx(
        """SELECT rec.customer_id, last_purchase_date, recency_days, lines
FROM rec JOIN (SELECT customer_id, count(*) AS lines FROM tx GROUP BY customer_id) n
     ON rec.customer_id = n.customer_id""",
        RECENCY,
    ),
)
def _(spark, folder):
    return recency.customer_recency(star.transactions(spark, folder, LABEL_COLUMNS))


@query(
    "purchased_rows",
    with_tx("SELECT customer_id, order_id, order_date, purchased FROM tx WHERE purchased = 1"),
)
def _(spark, folder):
    return recency.purchased_rows(star.transactions(spark, folder, LABEL_COLUMNS))


@query(
    "purchased_rows_none_bought",
    with_tx("SELECT customer_id, order_id, order_date, CAST(0 AS BIGINT) AS purchased FROM tx"),
)
def _(spark, folder):
    df = star.transactions(spark, folder, LABEL_COLUMNS)
    return recency.purchased_rows(df.withColumn("purchased", F.lit(0).cast("bigint")))


@query(
    "latest_customer_label",
    with_tx(
        """SELECT customer_id, purchased FROM (
  SELECT customer_id, purchased,
         row_number() OVER (PARTITION BY customer_id
                            ORDER BY order_date DESC NULLS FIRST, purchased DESC) AS place
  FROM (SELECT customer_id, purchased,
               CASE WHEN CAST(order_id AS BIGINT) % 97 <> 0 THEN order_date END AS order_date
        FROM tx) WHERE customer_id IS NOT NULL)
WHERE place = 1"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, LABEL_COLUMNS)
    gaps = F.when(F.col("order_id").cast("bigint") % 97 != 0, F.col("order_date"))
    return recency.latest_customer_label(df.withColumn("order_date", gaps), "purchased")


@query(
    "numeric_defaults",
    with_tx(
        """SELECT order_id, stock_code, coalesce(quantity, 0) AS quantity,
       coalesce(total_spend, 0) AS total_spend, CAST(1.9 AS DOUBLE) AS visited,
       CAST(purchased AS DOUBLE) AS purchased FROM raw""",
        UNCLEAN_LINES,
    ),
)
def _(spark, folder):
    df = features.numeric_defaults(unclean(spark, folder))
    return df.select("order_id", "stock_code", "quantity", "total_spend", "visited", "purchased")


@query(
    "scalar_functions",
    f"""SELECT o_orderkey,
       CAST({days("TIMESTAMP '1998-06-15 12:00:00'", 'o_orderdate')} AS BIGINT) AS days_to_noon,
       o_orderdate + INTERVAL 45 DAY AS shifted,
       CASE WHEN o_custkey % 5 = 0 THEN 0.0 ELSE o_totalprice / (o_custkey % 5) END AS ratio,
       round(ln(1 + o_totalprice), 9) AS log_price
FROM orders""",
)
def _(spark, folder):
    noon = F.lit("1998-06-15 12:00:00").cast("timestamp_ntz")
    when = F.col("o_orderdate")
    return star.table(spark, folder, "orders").select(
        "o_orderkey",
        elapsed_days(noon, when).cast("bigint").alias("days_to_noon"),
        shift_days(when, 45).alias("shifted"),
        safe_divide(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("ratio"),
        F.round(log1p_or_zero(F.col("o_totalprice")), 9).alias("log_price"),
    )


# --- filters ------------------------------------------------------------------------

WINDOW_COLUMNS = ("order_id", "order_date", "stock_code", "quantity")
for _window, _days in windows.WINDOW_DAYS.items():

    @query(
        f"time_window_{_window}",
        with_tx(
            f"""SELECT order_id, order_date, stock_code, quantity FROM tx
WHERE order_date >= (SELECT max(order_date) FROM tx) - INTERVAL {_days} DAY"""
        ),
    )
    def _(spark, folder, window=_window):
        df = star.transactions(spark, folder, WINDOW_COLUMNS)
        return windows.filter_time_window(df, window)


@query(
    "history_as_of",
    with_tx(
        """SELECT order_id, order_date, stock_code, quantity FROM tx,
     (SELECT max(order_date) - INTERVAL 90 DAY AS as_of FROM tx)
WHERE order_date <= as_of AND order_date >= as_of - INTERVAL 180 DAY"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, WINDOW_COLUMNS)
    return windows.history(df, windows.choose_as_of(df))


@query(
    "future_purchases",
    with_tx(
        """SELECT order_id, order_date, stock_code, purchased FROM tx,
     (SELECT max(order_date) - INTERVAL 90 DAY AS as_of FROM tx)
WHERE order_date > as_of AND order_date <= as_of + INTERVAL 60 DAY AND purchased = 1"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "order_date", "stock_code", "purchased"))
    return windows.future_purchases(df, windows.choose_as_of(df), horizon_days=60)


@query(
    "as_of_and_newest",
    with_tx(
        """SELECT max(order_date) - INTERVAL 90 DAY AS as_of, max(order_date) AS newest FROM tx"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_date",))
    as_of = F.lit(str(windows.choose_as_of(df))).cast("timestamp_ntz")
    return df.agg(F.max("order_date").alias("newest")).withColumn("as_of", as_of)


@query(
    "drop_returns",
    with_tx(
        """SELECT order_id, stock_code, signed AS quantity FROM (
  SELECT *, CASE WHEN purchased = 1 THEN quantity ELSE -quantity END AS signed FROM tx)
WHERE signed > 0 AND price > 0"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "stock_code", "quantity", "price", "purchased"))
    signed = F.when(F.col("purchased") == 1, F.col("quantity")).otherwise(-F.col("quantity"))
    return clean.drop_returns(df.withColumn("quantity", signed)).select(
        "order_id", "stock_code", "quantity"
    )


@query(
    "drop_missing_keys",
    with_tx(
        "SELECT order_id, customer_id, order_date FROM raw "
        "WHERE order_date IS NOT NULL AND customer_id IS NOT NULL",
        RETAIL,
    ),
)
def _(spark, folder):
    df = star.online_retail(spark, folder).select(
        F.col("Invoice").alias("order_id"),
        F.expr("cast(cast(`Customer ID` as double) as bigint)").cast("string").alias("customer_id"),
        F.expr("try_cast(InvoiceDate as timestamp_ntz)").alias("order_date"),
    )
    return clean.drop_missing_keys(df, "order_date", "customer_id")


@query(
    "sample_customers",
    with_tx(
        """SELECT customer_id, order_id, stock_code, quantity FROM tx WHERE customer_id IN (
  SELECT customer_id FROM (SELECT DISTINCT customer_id FROM tx WHERE customer_id IS NOT NULL)
  ORDER BY md5('42|' || customer_id), customer_id LIMIT 1000)"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("customer_id", "order_id", "stock_code", "quantity"))
    return windows.sample_customers(df)


# --- market -------------------------------------------------------------------------

SUMMARY_COLUMNS = ("category", "product", "stock_code", "location", "channel", "device",
                   "payment_method", "quantity", "total_spend", "order_date")
for _key in ("category", "product", "stock_code", "location"):

    @query(
        f"revenue_by_{_key}",
        with_tx(
            f"""SELECT {_key}, CAST(sum(total_spend) AS DOUBLE) AS total_spend FROM tx
WHERE {_key} IS NOT NULL GROUP BY {_key}"""
        ),
    )
    def _(spark, folder, key=_key):
        df = star.transactions(spark, folder, (key, "total_spend"))
        return market.market_research_summary(df)[f"revenue_by_{key}"]


@query(
    "quantity_by_product",
    with_tx("SELECT product, sum(quantity) AS quantity FROM tx WHERE product IS NOT NULL GROUP BY product"),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("product", "quantity"))
    return market.market_research_summary(df)["quantity_by_product"]


for _key in ("channel", "device", "location", "payment_method"):

    @query(
        f"orders_by_{_key}",
        with_tx(
            f"""SELECT key AS {_key}, count(*) AS orders FROM (
  SELECT CASE WHEN CAST(stock_code AS BIGINT) % 20 <> 0 THEN {_key} END AS key FROM tx)
GROUP BY key"""
        ),
    )
    def _(spark, folder, key=_key):
        df = star.transactions(spark, folder, (key, "stock_code"))
        gaps = F.when(F.col("stock_code").cast("bigint") % 20 != 0, F.col(key))
        return market.market_research_summary(df.select(gaps.alias(key)))[f"orders_by_{key}"]


# Period end of a date, as SQL.
PERIOD_SQL = {
    "ME": ("last_day(d)", "1 MONTH"),
    "D": ("d", "1 DAY"),
    "W": ("CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE)", "7 DAY"),
    "QE": ("last_day(CAST(date_trunc('quarter', d) + INTERVAL 2 MONTH AS DATE))", "3 MONTH"),
    "YE": ("last_day(CAST(date_trunc('year', d) + INTERVAL 11 MONTH AS DATE))", "1 YEAR"),
}


def period_sql(freq: str, where: str = "true", day: str = "CAST(order_date AS DATE)") -> str:
    label, step = PERIOD_SQL[freq]
    by_month = freq.endswith("E")
    start = "date_trunc('month', min(p))" if by_month else "CAST(min(p) AS TIMESTAMP)"
    mark = "last_day(CAST(g AS DATE))" if by_month else "CAST(g AS DATE)"
    return with_tx(
        f"""SELECT {mark} AS order_date, CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue
FROM (SELECT unnest(generate_series({start}, CAST(max(p) AS TIMESTAMP), INTERVAL {step})) AS g
      FROM sums)
LEFT JOIN sums ON p = {mark}""",
        f"""sums AS (
  SELECT {label} AS p, sum(total_spend) AS revenue
  FROM (SELECT {day} AS d, total_spend FROM tx
        WHERE order_date IS NOT NULL AND {where}) GROUP BY 1)""",
    )


for _freq, _name in (("ME", "month"), ("D", "day"), ("W", "week"), ("QE", "quarter"), ("YE", "year")):

    @query(f"revenue_over_time_{_name}", period_sql(_freq))
    def _(spark, folder, freq=_freq):
        df = star.transactions(spark, folder, ("order_date", "total_spend"))
        return market.revenue_over_time(df, freq=freq)


# Lines of three days in a row are put on the first of them, so that days without lines exist.
@query("revenue_over_time_with_empty_days", period_sql("D", "true", "CAST(order_date AS DATE) - CAST(epoch(order_date) // 86400 % 3 AS INTEGER)"))
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_date", "total_spend"))
    day = F.col("order_date").cast("date")
    first = F.date_sub(day, (F.unix_date(day) % 3).cast("int")).cast("timestamp_ntz")
    return market.revenue_over_time(df.withColumn("order_date", first), freq="D")


@query(
    "revenue_over_time_business_day",
    with_tx(
        """SELECT CAST(g AS DATE) AS order_date, CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue
FROM (SELECT unnest(generate_series(CAST(min(p) AS TIMESTAMP), CAST(max(p) AS TIMESTAMP), INTERVAL 1 DAY)) AS g FROM sums)
LEFT JOIN sums ON p = CAST(g AS DATE) WHERE isodow(g) < 6""",
        """sums AS (SELECT d - CAST(greatest(isodow(d) - 5, 0) AS INTEGER) AS p, sum(total_spend) AS revenue
  FROM (SELECT CAST(order_date AS DATE) AS d, total_spend FROM tx WHERE order_date IS NOT NULL) GROUP BY 1)""",
    ),
)
def _(spark, folder):
    return market.revenue_over_time(star.transactions(spark, folder, ("order_date", "total_spend")), freq="B")


# Events have a time of day: their value per six hours.
@query(
    "event_value_over_six_hours",
    """WITH sums AS (SELECT time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP), CAST('2000-01-01' AS TIMESTAMP)) AS p,
         sum(CAST(value AS DECIMAL(18,2))) AS revenue FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT g AS order_date, CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue
FROM (SELECT unnest(generate_series(min(p), max(p), INTERVAL 6 HOUR)) AS g FROM sums) LEFT JOIN sums ON p = g""",
)
def _(spark, folder):
    df = star.events(spark, folder).select(
        F.col("ts").cast("timestamp_ntz").alias("order_date"), F.col("value").cast("decimal(18,2)").alias("total_spend")
    )
    return market.revenue_over_time(df, freq="6h")


def top_sql(key: str, limit: int, value: str = "total_spend") -> str:
    return with_tx(
        f"""SELECT {key}, CAST(sum({value}) AS DOUBLE) AS {value} FROM tx
WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY sum({value}) DESC, {key} LIMIT {limit}"""
    )


@query("top_products", top_sql("product", 20))
def _(spark, folder):
    return market.top_entities(star.transactions(spark, folder, ("product", "total_spend")), "product")


@query("top_customers_by_quantity", top_sql("customer_id", 50, "quantity"))
def _(spark, folder):
    df = star.transactions(spark, folder, ("customer_id", "quantity"))
    return market.top_entities(df, "customer_id", "quantity", 50)


@query(
    "headline_numbers",
    with_tx(
        """SELECT count(*) AS rows, count(DISTINCT customer_id) AS customers,
       count(DISTINCT order_id) AS orders, CAST(sum(total_spend) AS DOUBLE) AS revenue FROM tx"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("customer_id", "order_id", "total_spend"))
    return market.headline_numbers(df)


@query(
    "category_cardinality",
    with_tx(
        "\nUNION ALL ".join(
            f'SELECT \'{c}\' AS "column", count(DISTINCT {c}) AS levels FROM tx'
            for c in (*LEVELS, "product")
        )
    ),
)
def _(spark, folder):
    names = [*LEVELS, "product"]
    return market.category_cardinality(star.transactions(spark, folder, names), names)


# --- baskets ------------------------------------------------------------------------


def basket_sql(order: str, item: str, least: int, orders: str = "true", items: str = "true") -> str:
    return with_tx(
        f"""SELECT a.item AS item_a, b.item AS item_b, count(*) AS pair_count
FROM basket a JOIN basket b ON a.ord = b.ord AND a.item < b.item
GROUP BY a.item, b.item HAVING count(*) >= {least}""",
        f"""lines AS (SELECT DISTINCT {order} AS ord, {item} AS item FROM tx
  WHERE {order} IS NOT NULL AND {item} IS NOT NULL)""",
        f"""basket AS (SELECT ord, item FROM (
    SELECT ord, item, row_number() OVER (PARTITION BY ord ORDER BY item) AS place FROM lines)
  WHERE {orders} AND {items})""",
    )


@query("basket_pairs", basket_sql("order_id", "product", 10))
def _(spark, folder):
    return baskets.basket_pairs(star.transactions(spark, folder, ("order_id", "product")))


@query("basket_pairs_high_support", basket_sql("order_id", "product", 45))
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "product"))
    return baskets.basket_pairs(df, min_pair_count=45)


@query("basket_pairs_of_stock_codes", basket_sql("order_id", "stock_code", 2))
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "stock_code"))
    return baskets.basket_pairs(df, item_col="stock_code", min_pair_count=2)


@query(
    "basket_pairs_limited",
    basket_sql(
        "order_id",
        "product",
        5,
        "ord IN (SELECT ord FROM (SELECT DISTINCT ord FROM lines) ORDER BY ord LIMIT 5000)",
        "place <= 3",
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "product"))
    return baskets.basket_pairs(df, min_pair_count=5, max_orders=5000, max_items_per_order=3)


@query("basket_pairs_per_customer", basket_sql("customer_id", "stock_code", 4))
def _(spark, folder):
    df = star.transactions(spark, folder, ("customer_id", "stock_code"))
    return baskets.basket_pairs(
        df, "customer_id", "stock_code", min_pair_count=4, large_order=40
    )


@query(
    "distinct_order_items",
    with_tx(
        "SELECT DISTINCT order_id, product FROM tx WHERE order_id IS NOT NULL AND product IS NOT NULL"
    ),
)
def _(spark, folder):
    return star.transactions(spark, folder, ("order_id", "product")).dropna().distinct()


# --- funnel -------------------------------------------------------------------------

FUNNEL_RATES = """
       CASE WHEN v = 0 THEN 0.0 ELSE a / v END AS visit_to_cart_rate,
       CASE WHEN a = 0 THEN 0.0 ELSE p / a END AS cart_to_purchase_rate,
       CASE WHEN v = 0 THEN 0.0 ELSE p / v END AS visit_to_purchase_rate"""


def funnel_sql(
    group: str = "", unit: str = "", source: str = "tx", more: tuple[str, ...] = (), extra: str = ""
) -> str:
    keys = [k for k in (unit, group) if k]
    lines = source
    if unit:
        lines = f"""(SELECT {', '.join(keys)}, max(visited) AS visited,
        max(added_to_cart) AS added_to_cart, max(purchased) AS purchased FROM {source}
        WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)})"""
    head = f"{group}, " if group else ""
    where = f"WHERE {group} IS NOT NULL GROUP BY {group}" if group else ""
    return with_tx(
        f"""SELECT {head}v AS visited_count, a AS added_to_cart_count, p AS purchased_count,
       {FUNNEL_RATES}{extra}
FROM (SELECT {head}CAST(coalesce(sum(visited), 0) AS BIGINT) AS v,
             CAST(coalesce(sum(added_to_cart), 0) AS BIGINT) AS a,
             CAST(coalesce(sum(purchased), 0) AS BIGINT) AS p
      FROM {lines} {where})""",
        *more,
    )


STAGES = ("visited", "added_to_cart", "purchased")


@query("funnel_of_lines", funnel_sql())
def _(spark, folder):
    return funnel.compute_funnel(star.transactions(spark, folder, STAGES))


@query("funnel_of_orders", funnel_sql(unit="order_id"))
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", *STAGES))
    return funnel.compute_funnel(df, unit_col="order_id")


for _key in ("channel", "category", "location"):

    @query(f"funnel_of_orders_by_{_key}", funnel_sql(_key, "order_id"))
    def _(spark, folder, key=_key):
        df = star.transactions(spark, folder, ("order_id", key, *STAGES))
        return funnel.compute_funnel(df, groupby=key, unit_col="order_id")


@query("funnel_of_lines_by_device", funnel_sql("device"))
def _(spark, folder):
    return funnel.compute_funnel(star.transactions(spark, folder, ("device", *STAGES)), "device")


@query(
    "funnel_bottleneck_by_category",
    funnel_sql(
        "category",
        "order_id",
        extra=""", CASE WHEN CASE WHEN v = 0 THEN 0.0 ELSE a / v END
             < CASE WHEN a = 0 THEN 0.0 ELSE p / a END
        THEN 'visit_to_cart' ELSE 'cart_to_purchase' END AS bottleneck""",
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "category", *STAGES))
    out = funnel.compute_funnel(df, "category", unit_col="order_id")
    return out.withColumn("bottleneck", funnel.bottleneck())


@query(
    "funnel_of_events_per_user_day",
    funnel_sql(
        unit="user_day",
        source="ev",
        more=(
            """ev AS (SELECT CAST(user_id AS VARCHAR) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)
         AS user_day,
         CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS visited,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS added_to_cart,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS purchased FROM events)""",
        ),
    ),
)
def _(spark, folder):
    return funnel.compute_funnel(star.event_funnel(spark, folder), unit_col="user_day")


@query(
    "attach_funnel_counts",
    with_tx(
        """SELECT order_id, tx.customer_id, stock_code, purchased,
       greatest(coalesce(carts, 1), 1) AS added_to_cart,
       greatest(coalesce(visits, 1), coalesce(carts, 1), 1) AS visited
FROM tx LEFT JOIN counts ON tx.customer_id = counts.customer_id""",
        """counts AS (SELECT CAST(user_id AS VARCHAR) AS customer_id,
         count(*) FILTER (WHERE event_type = 'view') AS visits,
         count(*) FILTER (WHERE event_type = 'click') AS carts FROM events GROUP BY user_id)""",
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("order_id", "customer_id", "stock_code", "purchased"))
    events = star.events(spark, folder).withColumn("customer_id", F.col("user_id").cast("string"))
    return funnel.attach_funnel_counts(df, events, "customer_id")


# --- features -----------------------------------------------------------------------

LOGS = ("revenue_total_log1p", "avg_order_value_log1p")


@query(
    "customer_features",
    with_tx(
        f"""SELECT feat.*, {RATES}, shares.* EXCLUDE (customer_id)
FROM feat JOIN shares ON feat.customer_id = shares.customer_id""",
        FEAT,
        f"shares AS (SELECT customer_id, {SHARES} FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)",
    ),
)
def _(spark, folder):
    return rounded(features.customer_features(star.transactions(spark, folder)), 9, *LOGS)


@query(
    "customer_features_after_cleaning",
    with_tx(
        f"SELECT feat.* EXCLUDE (recency_days), {RATES}, coalesce(rec.recency_days, 0) AS recency_days, "
        "shares.* EXCLUDE (customer_id) "
        "FROM feat JOIN shares USING (customer_id) LEFT JOIN rec ON feat.customer_id = rec.customer_id",
        FEAT,
        RECENCY,
        f"shares AS (SELECT customer_id, {SHARES} FROM tx WHERE customer_id IS NOT NULL GROUP BY customer_id)",
    ),
)
def _(spark, folder):
    cleaned = clean.coerce_transactions(star.transactions(spark, folder))
    return rounded(features.customer_features(cleaned), 9, *LOGS)


@query(
    "category_shares_of_many_levels",
    with_tx(
        """SELECT customer_id, 'category' AS "column", stock_code AS level,
       round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY customer_id) AS DOUBLE), 9) AS share
FROM tx WHERE customer_id IS NOT NULL AND stock_code IS NOT NULL GROUP BY customer_id, stock_code"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("customer_id", "stock_code"))
    long = features.category_shares_long(df.withColumnRenamed("stock_code", "category"))
    return rounded(long, 9, "share")


def asof_sql(lookback: str, stand_in: str) -> str:
    return with_tx(
        f"""SELECT feat.*, {RATES}, shares.* EXCLUDE (customer_id)
FROM feat JOIN shares ON feat.customer_id = shares.customer_id""",
        "moment AS (SELECT max(order_date) - INTERVAL 90 DAY AS as_of FROM tx)",
        f"""hist AS (SELECT tx.*, as_of FROM tx, moment
  WHERE customer_id IS NOT NULL AND order_date <= as_of AND {lookback})""",
        f"""feat AS (SELECT customer_id, {FEAT_COLUMNS},
    CAST(coalesce({days('any_value(as_of)', 'max(CASE WHEN purchased = 1 THEN order_date END)')},
                  {stand_in}) AS DOUBLE) AS recency_days
  FROM hist GROUP BY customer_id)""",
        f"shares AS (SELECT customer_id, {SHARES} FROM hist GROUP BY customer_id)",
    )


@query("customer_features_asof", asof_sql("order_date >= as_of - INTERVAL 180 DAY", "181"))
def _(spark, folder):
    df = star.transactions(spark, folder)
    out = features.customer_features_asof(df, windows.choose_as_of(df))
    return rounded(out, 9, *LOGS)


@query(
    "customer_features_asof_all_history",
    asof_sql("true", f"{days('(SELECT as_of FROM moment)', '(SELECT min(order_date) FROM hist)')} + 1"),
)
def _(spark, folder):
    df = star.transactions(spark, folder)
    out = features.customer_features_asof(df, windows.choose_as_of(df), lookback_days=None)
    return rounded(out, 9, *LOGS)


@query(
    "align_features",
    with_tx(
        "SELECT customer_id, orders, recency_days, CAST(0.0 AS DOUBLE) AS loyalty_points FROM feat",
        FEAT,
    ),
)
def _(spark, folder):
    wanted = ["orders", "recency_days", "loyalty_points"]
    aligned = features.align_features(base_features(spark, folder), wanted)
    return aligned.select("customer_id", *wanted)


@query(
    "selected_feature_means",
    with_tx(
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean FROM feat"
            for c in ("orders", "visits", "added_to_cart", "purchases", "revenue_total",
                      "avg_order_value", "avg_discount", "recency_days")
        ),
        FEAT,
    ),
)
def _(spark, folder):
    df = base_features(spark, folder)
    left_out = ("customer_id", "cart_rate", "purchase_rate", "cart_to_purchase_rate", *LOGS)
    names = features.select_feature_columns(df, left_out)
    means = df.agg(*[F.round(F.avg(c), 6).alias(c) for c in names])
    return means.unpivot([], names, "feature", "mean")


# --- ranks and quantiles ------------------------------------------------------------


@query(
    "revenue_percent_rank",
    with_tx(
        """SELECT customer_id, discount_level,
       CASE WHEN discount_level IS NOT NULL THEN
         (rank() OVER (ORDER BY discount_level) - 1
          + (count(*) OVER (PARTITION BY discount_level) + 1) / CAST(2 AS DOUBLE))
         / count(discount_level) OVER () END AS pct_rank
FROM (SELECT customer_id, CASE WHEN CAST(customer_id AS BIGINT) % 11 <> 0
                               THEN floor(revenue_total / 50000) END AS discount_level FROM feat)""",
        FEAT,
    ),
)
def _(spark, folder):
    df = base_features(spark, folder).select(
        "customer_id",
        F.when(
            F.col("customer_id").cast("bigint") % 11 != 0,
            F.floor(F.col("revenue_total") / 50000).cast("double"),
        ).alias("discount_level"),
    )
    return ranks.with_percent_rank(df, "discount_level")


@query(
    "revenue_quantiles",
    with_tx(
        """SELECT round(quantile_cont(revenue_total, 0.25), 6) AS q25,
       round(quantile_cont(revenue_total, 0.5), 6) AS q50,
       round(quantile_cont(revenue_total, 0.75), 6) AS q75 FROM feat""",
        FEAT,
    ),
)
def _(spark, folder):
    wanted = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    out = ranks.exact_quantiles(base_features(spark, folder), "revenue_total", wanted)
    return rounded(out, 6, *wanted)


@query(
    "line_price_quantiles_in_ranges",
    with_tx(
        """SELECT category, round(quantile_cont(price, 0.1), 6) AS q10,
       round(quantile_cont(price, 0.9), 6) AS q90 FROM tx WHERE category IS NOT NULL
GROUP BY category"""
    ),
)
def _(spark, folder):
    df = star.transactions(spark, folder, ("category", "price"))
    out = ranks.exact_quantiles(
        df, "price", {"q10": 0.1, "q90": 0.9}, ["category"], values_per_range=2000
    )
    return rounded(out, 6, "q10", "q90")


# --- segments -----------------------------------------------------------------------


@query(
    "segment_profiles",
    with_tx(
        """SELECT segment_id, round(avg(orders), 6) AS orders,
       round(avg(revenue_total), 4) AS revenue_total, round(avg(recency_days), 6) AS recency_days
FROM scored GROUP BY segment_id""",
        FEAT,
        SCORED,
    ),
)
def _(spark, folder):
    names = ["orders", "revenue_total", "recency_days"]
    out = segments.segment_profiles(scored_features(spark, folder), names)
    return rounded(rounded(out, 6, "orders", "recency_days"), 4, "revenue_total")


MEDIANS = """med AS (SELECT segment_id, round(median(revenue_total), 6) AS revenue_total,
  median(orders) AS orders, median(recency_days) AS recency_days FROM scored GROUP BY segment_id)"""
SEGMENT_RANKS = """ranked AS (SELECT *,
    CAST(dense_rank() OVER (ORDER BY revenue_total) AS INTEGER) AS revenue_total_rank,
    CAST(dense_rank() OVER (ORDER BY orders) AS INTEGER) AS orders_rank,
    CAST(dense_rank() OVER (ORDER BY recency_days DESC) AS INTEGER) AS recency_days_rank FROM med)"""
SEGMENT_SCORES = """points AS (SELECT *, CAST(revenue_total_rank AS DOUBLE) * CAST(0.5 AS DOUBLE)
    + CAST(orders_rank AS DOUBLE) * CAST(0.3 AS DOUBLE)
    + CAST(recency_days_rank AS DOUBLE) * CAST(0.2 AS DOUBLE) AS score FROM ranked)"""
SEGMENT_NAMED = """named AS (SELECT segment_id, CASE
    WHEN score >= quantile_cont(score, 0.75) OVER () THEN 'Champions'
    WHEN score >= quantile_cont(score, 0.5) OVER () THEN 'Loyal'
    WHEN score >= quantile_cont(score, 0.25) OVER () THEN 'Potential'
    ELSE 'At-Risk' END AS segment_name FROM points)"""


@query("segment_medians", with_tx("SELECT * FROM med", FEAT, SCORED, MEDIANS))
def _(spark, folder):
    names = ["revenue_total", "orders", "recency_days"]
    out = segments.segment_medians(scored_features(spark, folder), names)
    return rounded(out, 6, "revenue_total")


@query(
    "segment_ranks",
    with_tx(
        """SELECT segment_id, revenue_total_rank, orders_rank, recency_days_rank,
       round(score, 6) AS score, round(quantile_cont(score, 0.25) OVER (), 6) AS q25,
       round(quantile_cont(score, 0.5) OVER (), 6) AS q50,
       round(quantile_cont(score, 0.75) OVER (), 6) AS q75 FROM points""",
        FEAT,
        SCORED,
        MEDIANS,
        SEGMENT_RANKS,
        SEGMENT_SCORES,
    ),
)
def _(spark, folder):
    names = ["revenue_total", "orders", "recency_days"]
    medians = segments.segment_medians(scored_features(spark, folder), names)
    out = segments.name_by_score(segments.segment_ranks(medians)).drop(*names, "segment_name")
    return rounded(out, 6, "score", "q25", "q50", "q75")


@query(
    "name_segments",
    with_tx(
        """SELECT customer_id, s.segment_id, segment_name
FROM scored s LEFT JOIN named n ON s.segment_id = n.segment_id""",
        FEAT,
        SCORED,
        MEDIANS,
        SEGMENT_RANKS,
        SEGMENT_SCORES,
        SEGMENT_NAMED,
    ),
)
def _(spark, folder):
    named = segments.name_segments(scored_features(spark, folder))
    return named.select("customer_id", "segment_id", "segment_name")


SCALED = ("orders", "revenue_total", "recency_days")


@query(
    "standardize_features",
    with_tx(
        "SELECT customer_id, "
        + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED
        )
        + " FROM feat",
        FEAT,
    ),
)
def _(spark, folder):
    from pyspark.ml.functions import vector_to_array

    df = base_features(spark, folder).select("customer_id", *SCALED)
    scaled = segments.scale(segments.fit_scaler(df, SCALED), df, SCALED)
    values = vector_to_array("scaled")
    return scaled.select(
        "customer_id", *[F.round(values[i], 6).alias(c) for i, c in enumerate(SCALED)]
    )


@query("segment_customers")
def _(spark, folder):
    df = features.customer_features(star.transactions(spark, folder))
    result = segments.segment_customers(df)
    named = segments.name_segments(result.customers)
    return named.select("customer_id", "segment_id", "segment_name")


def squared_distance(x, centre) -> Column:
    parts = F.zip_with(x, centre, lambda a, b: (a - b) * (a - b))
    return F.aggregate(parts, F.lit(0.0), lambda total, d: total + d)


@query(
    "segment_customers_facts",
    with_tx("SELECT customer_id, true AS nearest, true AS centre_is_mean FROM feat", FEAT),
)
def _(spark, folder):
    """A fit that has come to its end: customers lie nearest to their own centre, which is their mean."""
    from pyspark.ml.functions import vector_to_array

    df = features.customer_features(star.transactions(spark, folder))
    result = segments.segment_customers(df)
    columns = features.select_feature_columns(df)
    scaled = segments.scale(result.scaler, result.customers, columns)
    scaled = materialize(scaled.select("customer_id", "segment_id", vector_to_array("scaled").alias("x")), "scaled")
    centres = [[float(v) for v in c] for c in result.model.clusterCenters()]
    away = F.array(*[squared_distance("x", F.lit(c)) for c in centres])
    nearest = F.get(away, "segment_id") <= F.array_min(away) + 1e-9
    means = scaled.select("segment_id", F.posexplode("x").alias("i", "v")).groupBy("segment_id", "i").agg(F.avg("v").alias("m"))
    gap = F.abs(F.col("m") - F.get(F.get(F.lit(centres), F.col("segment_id")), F.col("i")))
    means = means.groupBy("segment_id").agg((F.max(gap) < 0.02).alias("centre_is_mean"))
    joined = scaled.withColumn("nearest", nearest).join(F.broadcast(means), "segment_id")
    return joined.select("customer_id", "nearest", "centre_is_mean")


@query(
    "segment_silhouettes_facts",
    "SELECT CAST(k AS DOUBLE) AS k, true AS in_range FROM range(2, 9) AS r(k)",
)
def _(spark, folder):
    scores = segments.silhouette_scores(base_features(spark, folder))
    return scores.select("k", F.col("silhouette").between(-1, 1).alias("in_range"))


# Segments by a rule, so that both sides know them.
RULED = """CASE WHEN recency_days < 60 THEN 0 WHEN recency_days < 240 THEN 1 ELSE 2 END"""


@query(
    "silhouette_of_ruled_segments",
    with_tx(
        """SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (outside - inside) / greatest(inside, outside) END), 6) AS silhouette
FROM (SELECT customer_id, n, w / greatest(n - 1, 1) AS inside FROM sums WHERE s = t)
JOIN (SELECT customer_id, min(w / n) AS outside FROM sums WHERE s <> t GROUP BY customer_id) USING (customer_id)""",
        FEAT,
        f"points AS (SELECT customer_id, orders AS a, recency_days / 30 AS b, revenue_total / 100000 AS c, {RULED} AS s FROM feat)",
        """sums AS (SELECT p.customer_id, p.s, q.s AS t, count(*) AS n,
         sum(sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c))) AS w
  FROM points p, points q GROUP BY ALL)""",
    ),
)
def _(spark, folder):
    """The mean silhouette in plain distance, by its definition on the other side."""
    df = base_features(spark, folder)
    points = df.select(
        F.array(F.col("orders"), F.col("recency_days") / 30, F.col("revenue_total") / 100000).alias("x"),
        F.expr(RULED).alias("segment"), "customer_id",
    )
    points = materialize(points, "points")
    mean = silhouette.silhouette(points, F.col("x"), F.col("segment"), 3, row=F.col("customer_id"))
    return spark.createDataFrame([(round(mean, 6),)], "silhouette double")


@query("segment_silhouettes")
def _(spark, folder):
    return segments.silhouette_scores(features.customer_features(star.transactions(spark, folder)))


# --- churn --------------------------------------------------------------------------

AS_OF = "moment AS (SELECT max(order_date) - INTERVAL 90 DAY AS as_of FROM tx)"
FORWARD = """known AS (SELECT DISTINCT customer_id FROM tx, moment WHERE customer_id IS NOT NULL
    AND order_date <= as_of AND order_date >= as_of - INTERVAL 180 DAY),
labels AS (SELECT customer_id, CASE WHEN customer_id IN (
      SELECT customer_id FROM tx, moment WHERE customer_id IS NOT NULL AND purchased = 1
        AND order_date > as_of AND order_date <= as_of + INTERVAL 90 DAY)
    THEN 0 ELSE 1 END AS churn FROM known)"""


def forward_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = star.transactions(spark, folder, LABEL_COLUMNS)
    as_of = windows.choose_as_of(df)
    known = windows.history(df, as_of).select("customer_id").dropna().distinct()
    return churn.forward_churn_labels(df, as_of, known)


@query("forward_churn_labels", with_tx("SELECT customer_id, churn FROM labels", AS_OF, FORWARD))
def _(spark, folder):
    return forward_labels(spark, folder)


@query(
    "churn_class_counts",
    with_tx("SELECT churn, count(*) AS customers FROM labels GROUP BY churn", AS_OF, FORWARD),
)
def _(spark, folder):
    counts = churn.class_counts(forward_labels(spark, folder), "churn")
    return spark.createDataFrame(sorted(counts.items()), "churn int, customers bigint")


for _default in (0, 1):

    @query(
        f"customer_labels_default_{_default}",
        with_tx(
            f"""SELECT feat.customer_id, orders, coalesce(churn, {_default}) AS label
FROM feat LEFT JOIN labels ON feat.customer_id = labels.customer_id""",
            FEAT,
            AS_OF,
            FORWARD,
        ),
    )
    def _(spark, folder, default=_default):
        df = base_features(spark, folder).select("customer_id", "orders")
        return churn.with_labels(df, forward_labels(spark, folder), default)


@query(
    "stratified_split",
    with_tx(
        """SELECT customer_id, churn, row_number() OVER (PARTITION BY churn
         ORDER BY md5('42|' || customer_id), customer_id)
       <= round(count(*) OVER (PARTITION BY churn) * CAST(0.25 AS DOUBLE)) AS is_test
FROM labels""",
        AS_OF,
        FORWARD,
    ),
)
def _(spark, folder):
    return churn.stratified_split(forward_labels(spark, folder), "churn")


def labelled_risks(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_features(spark, folder).select("customer_id", "churn_risk").dropna()
    return churn.with_labels(scored, forward_labels(spark, folder), 1)


LABELLED = """lr AS (SELECT scored.customer_id, churn_risk, coalesce(churn, 1) AS label
  FROM scored LEFT JOIN labels ON scored.customer_id = labels.customer_id
  WHERE churn_risk IS NOT NULL)"""


@query(
    "classification_metrics",
    with_tx(
        """SELECT tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
FROM (SELECT count(*) FILTER (WHERE label = 1 AND churn_risk >= 0.5) AS tp,
             count(*) FILTER (WHERE label = 0 AND churn_risk >= 0.5) AS fp,
             count(*) FILTER (WHERE label = 1 AND churn_risk < 0.5) AS fn,
             count(*) FILTER (WHERE label = 0 AND churn_risk < 0.5) AS tn FROM lr)""",
        FEAT,
        SCORED,
        AS_OF,
        FORWARD,
        LABELLED,
    ),
)
def _(spark, folder):
    return churn.confusion(labelled_risks(spark, folder))


@query(
    "roc_auc",
    with_tx(
        """SELECT round(CAST(count(*) FILTER (WHERE p.churn_risk > n.churn_risk)
             + count(*) FILTER (WHERE p.churn_risk = n.churn_risk) / CAST(2 AS DOUBLE) AS DOUBLE)
       / count(*), 9) AS roc_auc
FROM (SELECT churn_risk FROM lr WHERE label = 1) p, (SELECT churn_risk FROM lr WHERE label = 0) n""",
        FEAT,
        SCORED,
        AS_OF,
        FORWARD,
        LABELLED,
    ),
)
def _(spark, folder):
    return rounded(churn.roc_auc(labelled_risks(spark, folder)), 9, "roc_auc")


def churn_run(spark: SparkSession, folder: str) -> dashboard.ChurnRun:
    return dashboard.run_churn(star.transactions(spark, folder))


@query("churn_model_metrics")
def _(spark, folder):
    metrics = churn_run(spark, folder).model.metrics
    return spark.createDataFrame(sorted(metrics.items()), "metric string, value double")


@query("churn_risks")
def _(spark, folder):
    return churn_run(spark, folder).risks


def time_split(spark: SparkSession, folder: str):
    """The model fitted to an early period, and the later one's customers with label and risk."""
    df = star.transactions(spark, folder)
    late = windows.choose_as_of(star.transactions(spark, folder, ("order_date",)))
    early = late - timedelta(days=90)
    df = windows.recent(df, early)
    sides = []
    for as_of in (early, late):
        frame = materialize(features.customer_features_asof(df, as_of), "side")
        labels = materialize(churn.forward_churn_labels(df, as_of, frame), "side-labels")
        sides.append((frame, labels))
    (train, train_labels), (test, test_labels) = sides
    result = churn.train_churn_model_time_split(
        train, test, features.select_feature_columns(train), train_labels, test_labels
    )
    scored = churn.predict_churn_risk(result, test).join(test_labels, "customer_id")
    return result, scored.select(F.col("churn").alias("label"), "churn_risk")


@query("churn_time_split_metrics")
def _(spark, folder):
    result, _ = time_split(spark, folder)
    rows = sorted(result.metrics.items()) + [("test_size", float(result.metadata["test_size"]))]
    return spark.createDataFrame(rows, "metric string, value double")


def recounted(scored: DataFrame) -> dict[str, float]:
    """The metrics of (label, churn_risk), counted another way than the library does."""
    test = scored.selectExpr("label = 1 AS y", "churn_risk >= 0.5 AS p", "churn_risk")
    counted = test.selectExpr(
        "avg(if(y = p, 1, 0)) AS accuracy",
        "coalesce(try_divide(count_if(y AND p), count_if(p)), 0) AS precision",
        "coalesce(try_divide(count_if(y AND p), count_if(y)), 0) AS recall",
        "coalesce(try_divide(2 * count_if(y AND p), count_if(y) + count_if(p)), 0) AS f1",
    ).first().asDict()
    # The area under the curve by its trapezoids: those of the scores, from the highest down, in a
    # thousand slices of the score first, so that no task holds them all.
    slices = test.groupBy((F.col("churn_risk") * 1000).cast("int").alias("slice"), "churn_risk")
    steps = slices.agg(F.count_if("y").alias("up"), F.count_if(~F.col("y")).alias("right"))
    inside = Window.partitionBy("slice").orderBy(F.desc("churn_risk"))
    height = F.sum("up").over(inside) - F.col("up") / 2
    areas = steps.select("slice", "up", "right", (height * F.col("right")).alias("area")).groupBy("slice").agg(
        F.sum("up").alias("up"), F.sum("right").alias("right"), F.sum("area").alias("area")
    )
    before = F.sum("up").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("slice"))) - F.col("up")
    total = areas.select("up", "right", (F.col("area") + before * F.col("right")).alias("area"))
    counted["roc_auc"] = total.agg(F.try_divide(F.sum("area"), F.sum("up") * F.sum("right"))).first()[0]
    return counted


ASOF_FEATURES = (
    "orders", "visits", "added_to_cart", "purchases", "revenue_total", "avg_discount",
    "avg_order_value", "recency_days", "cart_rate", "purchase_rate", "cart_to_purchase_rate",
    *[f"{c}_share__{v}" for c, values in LEVELS.items() for v in values],
    "revenue_total_log1p", "avg_order_value_log1p",
)


def truths(column: str, names, also: str) -> str:
    rows = ", ".join(f"('{n}', true)" for n in names)
    return f"SELECT * FROM (VALUES {rows}) AS t({column}, {also})"


def churn_fit(spark: SparkSession, folder: str):
    """The model of the run, and its customers with label, side of the split and scaled values."""
    from pyspark.ml.functions import vector_to_array

    df = star.transactions(spark, folder)
    as_of = windows.choose_as_of(star.transactions(spark, folder, ("order_date",)))
    df = windows.recent(df, as_of)
    past = materialize(features.customer_features_asof(df, as_of), "past")
    labels = materialize(churn.forward_churn_labels(df, as_of, past), "labels")
    columns = features.select_feature_columns(past)
    result = churn.train_churn_model(past, labels, columns)
    split = churn.stratified_split(churn.with_labels(past, labels, 0))
    scaled = segments.scale(result.scaler, split, columns)
    risks = churn.predict_churn_risk(result, past)
    rows = scaled.join(risks, "customer_id").select(
        "customer_id", "label", "is_test", "churn_risk", vector_to_array("scaled").alias("x")
    )
    return result, materialize(rows, "fit")


@query("churn_gradient_facts", truths("feature", ASOF_FEATURES, "at_optimum"))
def _(spark, folder):
    """At the optimum the penalised loss has no slope along any feature."""
    result, rows = churn_fit(spark, folder)
    train = rows.where(~F.col("is_test"))
    counts = churn.class_counts(train)
    n = sum(counts.values())
    weight = F.when(F.col("label") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    pull = weight * (F.col("churn_risk") - F.col("label"))
    slopes = train.select(pull.alias("pull"), F.posexplode("x").alias("i", "v")).groupBy("i")
    slopes = slopes.agg((F.sum(F.col("pull") * F.col("v")) / n).alias("slope"))
    betas = [float(b) for b in result.model.coefficients]
    penalty = F.get(F.lit(betas), F.col("i")) / n
    name = F.get(F.lit(result.feature_columns), F.col("i"))
    return slopes.select(name.alias("feature"), (F.abs(F.col("slope") + penalty) < 1e-3).alias("at_optimum"))


@query(
    "churn_risks_facts",
    with_tx(
        """SELECT DISTINCT customer_id, true AS is_logistic FROM tx, moment
WHERE customer_id IS NOT NULL AND order_date <= as_of AND order_date >= as_of - INTERVAL 180 DAY""",
        AS_OF,
    ),
)
def _(spark, folder):
    """A risk is the logistic curve at the weighted sum of the scaled features."""
    result, rows = churn_fit(spark, folder)
    betas = [float(b) for b in result.model.coefficients]
    terms = F.zip_with("x", F.lit(betas), lambda a, b: a * b)
    z = F.aggregate(terms, F.lit(float(result.model.intercept)), lambda total, t: total + t)
    gap = F.abs(F.col("churn_risk") - 1 / (1 + F.exp(-z)))
    return rows.select("customer_id", (gap < 1e-9).alias("is_logistic"))


@query("churn_model_metrics_facts", truths("metric", ("accuracy", "precision", "recall", "f1", "roc_auc"), "recomputed"))
def _(spark, folder):
    """The metrics of the fit, counted again from the scored rows it did not learn from."""
    result, rows = churn_fit(spark, folder)
    counted = recounted(rows.where("is_test"))
    same = [(name, abs(counted[name] - value) < 1e-9) for name, value in sorted(result.metrics.items())]
    return spark.createDataFrame(same, "metric string, recomputed boolean")


@query(
    "churn_time_split_facts",
    with_tx(
        "SELECT count(*) AS test_size, count_if(churn = 1) AS churned, true AS recomputed FROM labels", AS_OF, FORWARD,
    ),
)
def _(spark, folder):
    """Who is measured, how many of them churned, and the metrics counted again from their risks."""
    result, scored = time_split(spark, folder)
    scored = materialize(scored, "scored-again")
    size = result.metadata["test_size"]
    counted = recounted(scored)
    same = size == scored.count() and all(abs(counted[name] - value) < 1e-9 for name, value in result.metrics.items())
    churned = scored.where("label = 1").count()
    return spark.createDataFrame([(size, churned, same)], "test_size bigint, churned bigint, recomputed boolean")


@query(
    "top_churn_risks",
    with_tx(
        """SELECT customer_id, churn_risk FROM scored
ORDER BY churn_risk DESC NULLS LAST, customer_id LIMIT 50""",
        FEAT,
        SCORED,
    ),
)
def _(spark, folder):
    return churn.top_risks(scored_features(spark, folder))


@query(
    "risk_histogram",
    with_tx(
        """SELECT CAST(least(floor(churn_risk * 20), 19) AS INTEGER) AS bin, count(*) AS customers
FROM scored WHERE churn_risk IS NOT NULL GROUP BY 1""",
        FEAT,
        SCORED,
    ),
)
def _(spark, folder):
    return churn.risk_histogram(scored_features(spark, folder))


# --- decisions ----------------------------------------------------------------------

DECIDED = f"""decided AS (SELECT customer_id, segment_id, churn_risk, CASE
    WHEN churn_risk >= 0.7 OR recency_days >= 90 THEN '{decide.RETENTION}'
    WHEN revenue_total >= q AND churn_risk >= 0.4 THEN '{decide.PROTECT}'
    WHEN revenue_total >= q THEN '{decide.UPSELL}'
    WHEN churn_risk <= 0.2 AND recency_days <= 30 THEN '{decide.ENGAGE}'
    ELSE '{decide.NURTURE}' END AS recommended_action,
  round((1 - churn_risk) * 0.5 + 0.5 *
    (rank() OVER (ORDER BY revenue_total) - 1
     + (count(*) OVER (PARTITION BY revenue_total) + 1) / CAST(2 AS DOUBLE)) / count(*) OVER (), 9)
    AS decision_score
  FROM scored, (SELECT quantile_cont(revenue_total, 0.75) AS q FROM scored))"""


@query(
    "recommend_actions",
    with_tx(
        "SELECT customer_id, churn_risk, recommended_action, decision_score FROM decided",
        FEAT,
        SCORED,
        DECIDED,
    ),
)
def _(spark, folder):
    out = decide.recommend_actions(scored_features(spark, folder))
    return rounded(
        out.select("customer_id", "churn_risk", "recommended_action", "decision_score"),
        9,
        "decision_score",
    )


@query(
    "decision_table",
    with_tx(
        """SELECT customer_id, segment_name, churn_risk, recommended_action
FROM decided d LEFT JOIN named n ON d.segment_id = n.segment_id""",
        FEAT,
        SCORED,
        MEDIANS,
        SEGMENT_RANKS,
        SEGMENT_SCORES,
        SEGMENT_NAMED,
        DECIDED,
    ),
)
def _(spark, folder):
    named = segments.name_segments(scored_features(spark, folder))
    return decide.decision_table(decide.recommend_actions(named))


@query(
    "join_churn_risk",
    with_tx(
        """SELECT feat.customer_id, orders, churn_risk
FROM feat LEFT JOIN (SELECT customer_id, churn_risk FROM scored WHERE churn_risk IS NOT NULL) r
     ON feat.customer_id = r.customer_id""",
        FEAT,
        SCORED,
    ),
)
def _(spark, folder):
    risks = scored_features(spark, folder).select("customer_id", "churn_risk").dropna()
    base = base_features(spark, folder).select("customer_id", "orders")
    return decide.with_risks(base, risks)


@query("dashboard_decisions")
def _(spark, folder):
    typed = clean.coerce_columns(star.transactions(spark, folder))
    return dashboard.run_dashboard(typed, add_recency=True)["decisions"]


@query(
    "dashboard_decisions_facts",
    with_tx("SELECT customer_id, true AS follows_the_rules FROM feat", FEAT),
)
def _(spark, folder):
    """Each decision of the whole run, decided again from its own columns."""
    typed = clean.coerce_columns(star.transactions(spark, folder))
    tables = dashboard.run_dashboard(typed, add_recency=True)
    known = tables["segments"].select("customer_id", "revenue_total", "recency_days")
    high = ranks.exact_quantiles(known, "revenue_total", {"q": 0.75}).first()[0]
    risk, recency, rich = F.col("churn_risk"), F.col("recency_days"), F.col("revenue_total") >= high
    expected = (
        F.when((risk >= 0.7) | (recency >= 90), decide.RETENTION)
        .when(rich & (risk >= 0.4), decide.PROTECT)
        .when(rich, decide.UPSELL)
        .when((risk <= 0.2) & (recency <= 30), decide.ENGAGE)
        .otherwise(decide.NURTURE)
    )
    joined = tables["decisions"].join(known, "customer_id")
    return joined.select("customer_id", (F.col("recommended_action") == expected).alias("follows_the_rules"))
