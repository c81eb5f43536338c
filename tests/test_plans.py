"""Plan-shape guards: the scale properties the design relies on."""

import re

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

EXPECTED_EXCHANGES = {
    "forecast_responses": 3,  # distinct keys, slots, buckets; the answers' join is by broadcast
    "lag_lookup_days": 1,
    "lag_lookup_two_level": 2,
    "request_validation": 0,
    "notification_roundtrip": 0,
    "station_lookup": 2,  # planned as a shuffle join; see the test of the plan that runs
    "history_retention": 1,
}


def plan_of(spark, name):
    return entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(EXPECTED_EXCHANGES))
def test_exchange_count(spark, name):
    plan = plan_of(spark, name)
    assert len(re.findall(r"Exchange (hashpartitioning|SinglePartition|RoundRobin)", plan)) == EXPECTED_EXCHANGES[name]


def test_station_names_are_broadcast_once_measured(spark):
    df = entry.queries()["station_lookup"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final and "BroadcastHashJoin" in final.split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql())))
def test_no_pairwise_joins_or_python_udfs(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, bad


def test_flagship_scans_are_pruned_and_filtered(spark):
    plan = plan_of(spark, "forecast_responses")
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    history_scan = [s for s in scans if "value:double" in s]
    assert history_scan and "props" not in history_scan[0].split("ReadSchema")[1]
    assert "In(event_type, [click,view])" in history_scan[0]
    assert "GreaterThan(ts," in history_scan[0]  # bounded to the requests' time range


@pytest.mark.parametrize("name", ["forecast_responses", "forecast_responses_hourly", "forecast_model_path", "response_snapshot"])
def test_requests_are_parsed_before_the_plan(spark, name):
    """Filters see typed columns; the history is the one scan of events that is left."""
    lines = plan_of(spark, name).split("\n")
    assert not [x for x in lines if "Filter" in x and ("RLIKE" in x or "get_json_object" in x)]
    assert sum("FileScan parquet" in x and "events.parquet" in x for x in lines) <= 1
