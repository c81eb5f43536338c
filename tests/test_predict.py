"""End to end: every flattened entity gets exactly one response row."""

import json

from pyspark.sql import functions as F

from dockcast.config import DAY, RunParams
from dockcast.operators.requests import extract_requests
from dockcast.plans.predict import predict
from dockcast.sources.notifications import flatten_entities
from dockcast.sources.tables import events_history

from conftest import SF_SMALL
from test_requests import entity, notification


def test_broken_empty_and_mixed_notifications_all_answered(spark):
    lines = [
        "{broken",
        notification(),
        notification(entity(city="Barcelona", station="3", eid="a"), entity(city="Malaga", station="4", eid="b")),
        notification(entity(city="Nowhere", eid="c")),
        notification(entity(city="Santander", station="99", eid="d")),
    ]
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    req = extract_requests(flatten_entities(raw), requested_at=F.lit("2024-01-15 12:00:00"))
    out = predict(req, events_history(spark, SF_SMALL), params=RunParams(lag_unit=DAY)).collect()
    assert len(out) == 6
    by_status = sorted(r.status for r in out)
    assert by_status.count("unknown_city") == 3  # broken JSON, empty notification, unknown city
    assert "invalid_request" in by_status
    malaga = [r for r in out if r.city == "Malaga"][0]
    # baseline without lags: class (station + weekday + hour) mod 11, times 10
    assert malaga.status == "ok" and malaga.predictionValue == (4 + malaga.weekday + malaga.hour) % 11 * 10 > 0
    for r in out:
        payload = json.loads(r.payload)
        assert payload["predictionValue"]["value"] == r.predictionValue
        if r.status != "ok":
            assert r.predictionValue == -1
