"""Every registered query equals its DuckDB twin (sf0.001; the driver uses sf0.01)."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

from conftest import SF_SMALL

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(entry.queries()[name](spark, SF_SMALL), con, SQL[name])
    assert ok, msg


def test_every_query_has_rows_or_is_ml(spark):
    qs = entry.queries()
    missing = set(qs) - set(SQL) - set(entry.LLM_QUERIES)
    assert missing <= {"train_evaluate", "forecast_with_models"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "payload" in df.columns


@pytest.mark.parametrize("name", ["forecast_responses", "history_retention", "training_table_barcelona"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ok, msg = compare(entry.queries()[name](spark, SF_SMALL), con, SQL[name])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, msg
