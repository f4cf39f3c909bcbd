"""The registered text queries against their SQL, and their columns."""

import compare_with_sql
import pytest

from tillwise.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return compare_with_sql.connect(FOLDER)


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    got = compare_with_sql.spark_rows(QUERIES[name](spark, FOLDER))
    expected = compare_with_sql.sql_rows(tables, ORACLES[name])
    assert compare_with_sql.difference(got, expected) is None


def test_running_totals_are_exact(spark):
    from pyspark.sql import functions as F

    from tillwise.llm.common import running_totals

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 11).alias("v"))
    got = sorted((r.k, r.before) for r in running_totals(df, [F.col("k")], "x", before=F.col("v")).collect())
    total, expected = 0, []
    for k, v in sorted((i * 7919 % 5003, i % 11) for i in range(5000)):
        expected.append((k, total))
        total += v
    assert got == expected


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
