import random

from conftest import at, rows
from pyspark.sql import functions as F

import pytest

from tillwise.functions.scalars import (
    elapsed_days,
    flag,
    id_text,
    log1p_or_zero,
    moment,
    number,
    safe_divide,
    text,
)
from tillwise.operators import clean, recency, windows
from tillwise.session import materialize
from tillwise.sources import readers


def test_number_reads_or_yields_null(frame):
    df = frame("v string", ("1.5",), (" 12 ",), ("abc",), ("1.5d",), ("2f",), ("NaN",), (None,), ("1e3",))
    got = [r[0] for r in df.select(number(df, "v")).collect()]
    assert got == [1.5, 12.0, None, None, None, None, None, 1000.0]


def test_nan_becomes_null(frame):
    df = frame("v double", (float("nan"),), (2.0,))
    assert [r[0] for r in df.select(number(df, "v")).collect()] == [None, 2.0]


def test_flag_cuts_toward_zero(frame):
    df = frame("v string", ("1.9",), ("-1.9",), ("x",), (None,))
    assert [r[0] for r in df.select(flag(df, "v")).collect()] == [1, -1, 0, 0]


def test_moment_reads_or_yields_null(frame):
    df = frame("v string", ("2020-02-03",), ("2020-02-03 04:05:06",), ("soon",), (None,))
    got = [r[0] for r in df.select(moment(df, "v")).collect()]
    assert got == [at("2020-02-03"), at("2020-02-03T04:05:06"), None, None]
    other = frame("v string", ("12/1/2010 8:26",), ("bad",))
    got = [r[0] for r in other.select(moment(other, "v", "M/d/yyyy H:mm")).collect()]
    assert got == [at("2010-12-01T08:26"), None]


def test_ids_lose_their_fraction(frame):
    df = frame("v string", ("17850.0",), ("9007199254740993",), ("1.5",), (None,))
    got = [r[0] for r in df.select(id_text(df, "v")).collect()]
    assert got == ["17850", "9007199254740993", None, None]
    doubles = frame("v double", (17850.0,), (float("nan"),))
    assert [r[0] for r in doubles.select(id_text(doubles, "v")).collect()] == ["17850", None]


def test_missing_text_reads_nan(frame):
    assert frame("v string", (None,)).select(text("v")).first()[0] == "nan"


@pytest.mark.parametrize(
    "later, earlier, expected",
    [
        ("2020-01-02T00:30", "2020-01-01T23:00", 0),
        ("2020-01-02T23:00", "2020-01-01T23:00", 1),
        ("2020-01-01T22:00", "2020-01-01T23:00", -1),
        ("2020-01-01T23:00", "2020-01-02T23:00", -1),
        ("2020-01-01T22:59", "2020-01-02T23:00", -2),
        ("2021-01-01T00:00", "2020-01-01T00:00", 366),
    ],
)
def test_elapsed_days_rounds_down(frame, later, earlier, expected):
    df = frame("a timestamp_ntz, b timestamp_ntz", (at(later), at(earlier)))
    assert df.select(elapsed_days(F.col("a"), F.col("b"))).first()[0] == expected


def test_safe_divide_and_log(frame):
    df = frame("a double, b double", (1.0, 0.0), (1.0, 4.0), (None, 2.0), (1.0, None))
    assert [r[0] for r in df.select(safe_divide(F.col("a"), F.col("b"))).collect()] == [0, 0.25, 0, 0]
    assert frame("a double", (-2.0,)).select(log1p_or_zero(F.col("a"))).first()[0] == 0.0


def test_coercion_and_recency(frame):
    df = frame(
        "customer_id string, order_date string, purchased string, quantity string",
        ("a", "2020-01-01", "1", "2"),
        ("a", "2020-03-01", "x", "bad"),
        ("b", "2020-02-01", "0", "1"),
        ("b", "not a date", "1", "1"),
        (None, "2020-03-11 12:00:00", "1", "1"),
    )
    got = rows(clean.coerce_transactions(df), F.asc_nulls_last("customer_id"), "order_date")
    # The row without a customer sets the newest moment; b bought nothing with a date.
    assert got == [
        ("a", at("2020-01-01"), 1, 2.0, at("2020-01-01"), 70.0),
        ("a", at("2020-03-01"), 0, None, at("2020-01-01"), 70.0),
        ("b", at("2020-02-01"), 0, 1.0, None, None),
        (None, at("2020-03-11T12:00"), 1, 1.0, None, None),
    ]


def test_recency_uses_all_rows_when_nothing_was_bought(frame):
    df = frame(
        "customer_id string, order_date timestamp_ntz, purchased int",
        ("a", at("2020-01-01"), 0),
        ("b", at("2020-01-11"), 0),
    )
    got = rows(recency.ensure_recency(df).select("customer_id", "recency_days"), "customer_id")
    assert got == [("a", 10.0), ("b", 0.0)]


def test_present_recency_column_is_kept(frame):
    df = frame(
        "customer_id string, order_date timestamp_ntz, recency_days double",
        ("a", at("2020-01-01"), 5.0),
    )
    out = recency.ensure_recency(df).first().asDict()
    assert out["recency_days"] == 5.0 and out["last_purchase_date"] == at("2020-01-01")
    plain = frame("x int", (1,))
    assert recency.ensure_recency(plain).columns == ["x"]


RETAIL = "Invoice string, StockCode string, Description string, Quantity string, InvoiceDate string, Price string, `Customer ID` double, Country string"


def retail(frame):
    return frame(
        RETAIL,
        ("i1", "s1", None, "2", "2010-01-01 10:00:00", "1.5", 7.0, "UK"),
        ("i2", "s1", "cup", "-1", "2010-01-05", "1.5", 7.0, None),
        ("i3", "s2", "jar", "1", "2010-02-01", "0", 8.0, "UK"),
        ("i4", "s2", "jar", "1", "when", "2", 8.0, "UK"),
        ("i5", "s2", "jar", "1", "2010-02-01", "2", None, "UK"),
    )


def test_online_retail_layout(frame):
    raw = retail(frame)
    assert clean.is_online_retail(raw) and not clean.is_online_retail(raw.drop("Country"))
    out = clean.normalize_online_retail(raw).collect()
    assert len(out) == 1
    row = out[0].asDict()
    assert (row["customer_id"], row["product"], row["total_spend"]) == ("7", "nan", 3.0)
    assert (row["visited"], row["added_to_cart"], row["purchased"]) == (0, 0, 1)
    kept = clean.normalize_online_retail(raw, include_returns=True, add_churn=True, churn_threshold_days=27)
    got = rows(kept.select("order_id", "location", "total_spend", "recency_days", "churn"), "order_id")
    assert got == [
        ("i1", "UK", 3.0, 27.0, 1),
        ("i2", "nan", -1.5, 27.0, 1),
        ("i3", "UK", 0.0, 0.0, 0),
    ]


def test_churn_label_threshold_and_missing_recency(frame):
    df = frame("customer_id string, recency_days double", ("a", 90.0), ("b", 89.0), ("c", None))
    assert [r["churn"] for r in clean.add_churn_label(df).orderBy("customer_id").collect()] == [1, 0, 0]
    strict = clean.add_churn_label(df, inclusive=False).orderBy("customer_id").collect()
    assert [r["churn"] for r in strict] == [0, 0, 0]
    unknown = frame("customer_id string", ("a",))
    assert clean.add_churn_label(unknown).columns == ["customer_id"]


def test_files_of_both_layouts(frame, tmp_path, spark):
    csv = readers.write_table(retail(frame), str(tmp_path / "r.csv"), "csv")
    assert readers.load_dataset(spark, csv).count() == 1
    parquet = readers.write_table(retail(frame), str(tmp_path / "r"))
    assert readers.load_online_retail(spark, parquet, include_returns=True).count() == 3
    with pytest.raises(ValueError):
        readers.load_dataset(spark, "sheet.xls")
    renamed = readers.load_uploaded(spark, parquet, rename_only=True)
    assert renamed.where("order_id = 'i1'").first()["total_spend"] == 1.5
    assert readers.load_uploaded(spark, parquet).first()["total_spend"] == 3.0
    plain = frame("customer_id string, order_date string, churn string", ("a", "2020-01-01", "1.2"))
    path = readers.write_table(plain, str(tmp_path / "t.csv"), "csv")
    row = readers.load_transactions(spark, path).first()
    assert (row["churn"], row["recency_days"]) == (1, 0.0)


def test_latest_label_prefers_rows_without_date(frame):
    df = frame(
        "customer_id string, order_date timestamp_ntz, churn int",
        ("a", at("2020-01-01"), 0),
        ("a", at("2020-02-01"), 1),
        ("b", None, 0),
        ("b", at("2020-02-01"), 1),
        (None, at("2020-02-01"), 1),
    )
    assert rows(recency.latest_customer_label(df), "customer_id") == [("a", 1), ("b", 0)]
    with pytest.raises(ValueError):
        recency.latest_customer_label(df.drop("churn"))
    with pytest.raises(ValueError):
        recency.latest_customer_label(df.drop("order_date"))
    numbered = df.drop("order_date").withColumn("line", F.col("churn") * -1)
    assert rows(recency.latest_customer_label(numbered, order_by=["line"]), "customer_id") == [
        ("a", 0),
        ("b", 0),
    ]


def test_windows(frame):
    df = frame(
        "customer_id string, order_date timestamp_ntz, purchased int",
        ("a", at("2020-01-01"), 1),
        ("a", at("2020-03-01"), 1),
        ("b", at("2020-03-31"), 0),
        ("b", None, 1),
    )
    assert windows.filter_time_window(df, "all").count() == 4
    assert windows.filter_time_window(df, "last_30d").count() == 2
    assert windows.filter_time_window(df, "last_90d").count() == 3
    empty_dates = df.withColumn("order_date", F.lit(None).cast("timestamp_ntz"))
    assert windows.filter_time_window(empty_dates, "last_30d").count() == 4
    assert windows.filter_time_window(df.drop("order_date"), "last_30d").count() == 4
    assert windows.history(df, at("2020-03-01"), 60).count() == 2
    assert windows.history(df, at("2020-03-01"), 59).count() == 1
    assert windows.history(df, at("2020-03-01"), None).count() == 2
    assert windows.future_purchases(df, at("2020-01-01"), 60).count() == 1
    assert windows.future_purchases(df, at("2020-01-01"), 59).count() == 0
    assert windows.choose_as_of(df, 30) == at("2020-03-01")
    with pytest.raises(ValueError):
        windows.choose_as_of(empty_dates)
    with pytest.raises(ValueError):
        windows.choose_as_of(df.drop("order_date"))


def test_customer_sample_keeps_whole_customers(frame):
    df = frame("customer_id string, n int", *[(f"c{i % 7}", i) for i in range(21)], (None, 1))
    sample = windows.sample_customers(df, limit=3)
    counts = rows(sample.groupBy("customer_id").count(), "customer_id")
    assert len(counts) == 3 and all(n == 3 for _, n in counts)
    assert rows(sample, "n") == rows(windows.sample_customers(df, limit=3), "n")
    assert windows.sample_customers(df, limit=7).count() == 22


def test_window_filter_reaches_the_scan(frame, tmp_path, spark):
    df = frame("order_date timestamp_ntz", (at("2020-01-01"),), (at("2020-06-01"),))
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = windows.filter_time_window(stored, "last_30d")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(order_date" in plan


def test_intermediate_tables_go_where_the_session_says(frame, spark, shared_folder):
    df = frame("x int", (1,), (2,))
    stored = materialize(df, "t")
    assert stored.count() == 2
    assert stored.inputFiles()[0].startswith(f"file://{shared_folder}/t-")
    assert materialize(df.limit(0), "t").columns == ["x"]


RETAIL_HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def retail_file(tmp_path, *lines, name="x.csv"):
    path = tmp_path / name
    path.write_text(RETAIL_HEADER + "".join(line + "\n" for line in lines))
    return str(path)


def test_quotes_commas_and_line_breaks_in_csv(spark, tmp_path):
    lines = (
        '1,A,"12"" RULER, RED",2,2020-01-01 10:00:00,3.5,7,UK',
        '1,B,"two\nlines",1,2020-01-01 10:00:00,1.5,7,UK',
        '2,C,plain,1,2020-01-02 10:00:00,1,8,UK',
    )
    path = retail_file(tmp_path, *lines)
    got = readers.load_dataset(spark, path, multi_line=True)
    found = {r["stock_code"]: (r["product"], r["quantity"]) for r in got.collect()}
    assert found == {"A": ('12" RULER, RED', 2.0), "B": ("two\nlines", 1.0), "C": ("plain", 1.0)}
    # Without the option a broken record is an error, also where few columns are read.
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.read_table(spark, path).select("Invoice").collect()


def test_the_kind_of_a_file_is_stated_or_in_its_suffix(spark, tmp_path):
    import gzip

    text = RETAIL_HEADER + "1,A,x,2,2020-01-01,3.5,7,UK\n"
    folder = tmp_path / "plain"
    folder.mkdir()
    (folder / "part-0").write_text(text)
    (tmp_path / "x.tsv").write_text(text.replace(",", "\t"))
    with gzip.open(tmp_path / "y.csv.gz", "wt") as f:
        f.write(text)
    for path, options in ((folder, {"kind": "csv"}), (tmp_path / "x.tsv", {}), (tmp_path / "y.csv.gz", {})):
        assert [r["Country"] for r in readers.read_table(spark, str(path), **options).collect()] == ["UK"]
    with pytest.raises(ValueError):
        readers.read_table(spark, "a.xls")
    with pytest.raises(ValueError):
        readers.read_table(spark, "a", kind="xml")


def test_csv_round_trip_keeps_odd_text(spark, tmp_path):
    values = ['a"b', '"', "x,y", " blank ", "back\\slash", '\\"', "two\nlines", "é", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    path = readers.write_table(df, str(tmp_path / "odd.csv"), "csv")
    got = readers.read_table(spark, path, multi_line=True)
    assert [v for _, v in sorted((int(r["i"]), r["v"]) for r in got.collect())] == values


def test_dates_of_any_one_shape_are_found(spark, tmp_path):
    path = retail_file(tmp_path, "1,A,x,2,12/1/2010 8:26,3.5,7,UK", "2,A,x,2,12/13/2010 9:00,3.5,7,UK", "3,A,x,2,?,3.5,7,UK")
    got = readers.load_dataset(spark, path)
    assert sorted(r["order_date"] for r in got.collect()) == [at("2010-12-01T08:26"), at("2010-12-13T09:00")]
    reading = clean.date_readings(readers.read_table(spark, path), ["InvoiceDate"])["InvoiceDate"]
    assert reading == clean.DateReading("M/d/yyyy H:mm", 2, 1)


def test_dates_that_fit_two_shapes_or_none_are_errors(spark, tmp_path):
    both = retail_file(tmp_path, "1,A,x,2,12/1/2010 8:26,3.5,7,UK")
    with pytest.raises(ValueError, match="fit"):
        readers.load_dataset(spark, both)
    assert readers.load_dataset(spark, both, date_format="d/M/yyyy H:mm").first()["order_date"] == at("2010-01-12T08:26")
    none = retail_file(tmp_path, "1,A,x,2,first of May,3.5,7,UK", name="y.csv")
    with pytest.raises(ValueError, match="No date"):
        readers.load_dataset(spark, none)
    with pytest.raises(ValueError, match="No date"):
        readers.load_dataset(spark, both, date_format="yyyy")


def test_customers_with_letters_in_their_id_stay(spark, tmp_path):
    path = retail_file(tmp_path, "1,A,x,2,2020-01-01,3.5,C178,UK", "2,A,x,2,2020-01-01,3.5,17850.0,UK", "3,A,x,2,2020-01-01,3.5,,UK")
    assert sorted(r["customer_id"] for r in readers.load_dataset(spark, path).collect()) == ["17850", "C178"]


def test_recency_reads_only_the_columns_it_needs(spark):
    from tillwise.operators.recency import ensure_recency
    from tillwise.sources import star_schema as star

    df = spark.read.parquet(star_lines(spark))
    plan = ensure_recency(df).groupBy("recency_days").count()._jdf.queryExecution().executedPlan().toString()
    schemas = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema" in line and "total_spend" in line]
    assert not schemas
    assert star.TRANSACTION_COLUMNS


def star_lines(spark):
    from tillwise.session import shared_scratch
    from tillwise.sources import star_schema as star

    return readers.write_table(star.transactions(spark, "/root/testdata/sf0.001"), shared_scratch(spark, "lines"))


def test_lines_are_joined_once_for_what_belongs_to_orders(spark):
    from tillwise.sources import star_schema as star

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = star.transactions(spark, "/root/testdata/sf0.001", ("order_id", "location", "payment_method", "channel"))
        plan = df._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert len(joins) == 3 and "l_orderkey" in joins[0]
    assert sum("l_orderkey" in j for j in joins) == 1


def test_a_run_removes_its_own_tables(spark, shared_folder):
    from pathlib import Path

    from tillwise.session import materialize, scratch_run

    before = set(Path(shared_folder).iterdir())
    with scratch_run(spark) as folder:
        assert materialize(spark.range(3), "x").count() == 3
        assert Path(folder).exists() and Path(folder).parent == Path(shared_folder)
    assert set(Path(shared_folder).iterdir()) == before


def test_shapes_keep_every_value_that_a_pattern_reads(spark):
    """Each pattern reads the same values with and without looking at shapes first."""
    from datetime import datetime, timedelta

    draw = random.Random(3)
    formats = ["%m/%d/%Y %H:%M", "%d/%m/%Y %H:%M:%S", "%d.%m.%Y", "%Y/%m/%d", "%Y%m%d", "%d-%b-%Y", "%d %b %Y", "%Y-%m-%d %H:%M:%S", "%-m/%-d/%Y %-H:%M"]
    values = [(datetime(2009, 1, 1) + timedelta(minutes=draw.randrange(10**6))).strftime(draw.choice(formats)) for _ in range(500)]
    values += ["", " ", None, "31/02/2010", "13/13/2010", "1/2/2010 ", " 1/2/2010", "nothing", "2010", "20100101", "1-Foo-2010", "1/2/10", "2010/1/1 1:2:3", "99", "1 . 2"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    for pattern in clean.DATE_PATTERNS[1:]:
        read = clean.moment(df, "t", pattern)
        shaped = F.when(clean.date_shape(F.col("t")) == clean._pattern_shape(pattern), read)
        row = df.agg(F.count(read), F.count(shaped)).first()
        assert row[0] == row[1], pattern
    assert clean._pattern_shape("d-MMM-yyyy") == "9-A-9" and clean._pattern_shape("M/d/yyyy H:mm:ss") == "9/9/9 9:9:9"


def test_only_whole_numbers_reach_the_integer_cast(frame):
    texts = ["12", " 12\t", "+7", "-0.0", "17850.0", "5.", "00012.0", "12.5", "1e3", "", "nan", "A1", ".0",
             "9007199254740993.0", "9007199254740993", "99999999999999999999", "1 2", None]
    df = frame("v string", *[(t,) for t in texts])
    as_number = number(df, "v")
    whole = F.when(as_number == F.floor(as_number), as_number.try_cast("bigint"))
    other = F.when(as_number.isNull() & ~F.lower(F.trim("v")).isin("", "nan"), F.col("v"))
    plain = F.coalesce(F.coalesce(F.col("v").try_cast("bigint"), whole).cast("string"), other)
    assert [r[0] for r in df.select(id_text(df, "v")).collect()] == [r[0] for r in df.select(plain).collect()]
    # A failed cast is a caught exception, many times dearer than the check before it.
    assert "try_cast(v as bigint)" not in str(df.select(id_text(df, "v"))._jdf.queryExecution().analyzed())


def test_raw_lines_from_joins_are_made_once(frame):
    df = frame(
        "Invoice string, StockCode string, Description string, Quantity string, InvoiceDate string, Price string, `Customer ID` string, Country string",
        ("1", "s", "d", "2", "2010-12-01 08:26:00", "3", "17850.0", "UK"),
    )
    out = clean.normalize_online_retail(df.distinct())
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.select("customer_id", "total_spend").collect()] == [("17850", 6.0)]
    dated = frame("customer_id string, order_date string, total_spend string", ("1", "2010-12-01", "2"))
    out = clean.coerce_transactions(dated.distinct())
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_dates_that_cannot_fit_are_not_parsed():
    import re

    fits = lambda pattern, text: bool(re.search(clean._may_fit(pattern).replace("\\z", "\\Z"), text))
    assert fits("M/d/yyyy H:mm", "012/031/2010 8:26") and not fits("M/d/yyyy H:mm", "13/1/2010 8:26")
    assert fits("d/M/yyyy", "31/12/2010") and not fits("d/M/yyyy", "12/31/2010")
