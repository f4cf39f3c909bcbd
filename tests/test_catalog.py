"""The registered queries against their SQL, on the smallest tables."""

from pathlib import Path

import compare_with_sql
import pytest

from query_catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return compare_with_sql.connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    got = compare_with_sql.spark_rows(QUERIES[name](spark, FOLDER))
    expected = compare_with_sql.sql_rows(tables, ORACLES[name])
    assert compare_with_sql.difference(got, expected) is None


def test_whole_run_yields_every_table(spark, tmp_path, shared_folder):
    from tillwise.operators.clean import coerce_transactions
    from tillwise.plans.dashboard import run_dashboard, write_dashboard
    from tillwise.session import scratch_run
    from tillwise.sources.star_schema import transactions

    df = coerce_transactions(transactions(spark, FOLDER))
    before = set(Path(shared_folder).iterdir())
    with scratch_run(spark):
        tables = run_dashboard(df, n_clusters=3)
        write_dashboard(tables, str(tmp_path / "out"))
    assert set(Path(shared_folder).iterdir()) == before
    decisions = spark.read.parquet(str(tmp_path / "out" / "decisions"))
    assert decisions.count() == df.select("customer_id").distinct().count()
    assert len(tables) == 18
