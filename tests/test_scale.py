"""SURVEY §5 (5): a history self-replicated x20 - both lookup plans agree."""

from pyspark.sql import functions as F

from dockcast.config import DAY, RunParams
from dockcast.operators.lookup import lag_lookup
from dockcast.operators.requests import validate_requests
from dockcast.sources.tables import events_history, events_requests

SF = "/root/testdata/sf0.01"


def test_replicated_history_both_plans_agree(spark):
    hist = events_history(spark, SF)
    # each copy shifted by whole 30-day periods, with fresh reading ids
    big = hist.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).select(
        "city", "station_id",
        F.timestamp_add("DAY", F.col("copy") * 30, "ts").alias("ts"),
        "available",
        (F.col("reading_id") + F.col("copy") * F.lit(1 << 32)).alias("reading_id"),
    )
    req = validate_requests(events_requests(spark, SF))
    cols = ["request_id", "status", "slot1", "slot2", "slot3", "slot4"]
    a = lag_lookup(req, big, RunParams(lag_unit=DAY, lookup_plan="window")).select(*cols)
    b = lag_lookup(req, big, RunParams(lag_unit=DAY, lookup_plan="two_level", slot_seconds=3600)).select(*cols)
    assert a.count() == req.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
