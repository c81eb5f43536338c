"""Shaping, JSON payload and last write wins."""

import datetime as dt
import json

from dockcast.operators.responses import latest_per_key, shape_responses

SCHEMA = (
    "request_id long, socket_id string, prediction_id string, city string, station_id int, id_station string, "
    "weekday int, hour int, month int, status string, steps int, prediction double"
)


def test_shape_and_payload(spark):
    rows = [
        (1, 's"1', "p-1", "Barcelona", 7, "07", 3, 20, 3, "ok", 2, 9.5),
        (2, "s-2", "p-2", "Malaga", 4, "4", 1, 8, 2, "ok", 1, 6.0),
        (3, "s-3", "p-3", "Santander", 3, "3", 2, 9, 4, "no_history", None, None),
        (4, "s-4", "p-4", "Santander", None, "x", 2, 9, 4, "malformed", None, None),
    ]
    out = {r.request_id: r for r in shape_responses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1].predictionValue == 10 and out[1].idStation == "7"  # half up; station as parsed int
    assert out[2].predictionValue == 60  # class x 10
    assert out[3].predictionValue == -1 and out[4].predictionValue == -1 and out[4].idStation == "x"
    payload = json.loads(out[1].payload)
    assert list(payload) == ["socketId", "predictionId", "predictionValue", "idStation", "weekday", "hour", "month", "city"]
    assert payload["socketId"] == {"value": 's"1', "type": "Property"}
    assert payload["predictionValue"] == {"value": 10, "type": "Property"}


def test_latest_per_key(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("Barcelona", "1", 5, t, 1), ("Barcelona", "1", 6, t + dt.timedelta(hours=1), 2),
            ("Barcelona", "1", 7, t + dt.timedelta(hours=1), 3), ("Santander", "1", 1, t, 4)]
    df = spark.createDataFrame(rows, "city string, idStation string, v int, produced_at timestamp_ntz, request_id long")
    got = {(r.city, r.idStation): r.v for r in latest_per_key(df, ["city", "idStation"], ["produced_at", "request_id"]).collect()}
    assert got == {("Barcelona", "1"): 7, ("Santander", "1"): 1}


def test_r2_is_stable_and_null_for_constant_labels(spark):
    from dockcast.operators.metrics import regression_metrics

    rows = [(1e9 + i % 7, 1e9 + i % 7 + (0.5 if i % 2 else -0.5)) for i in range(70)]
    y = [r[0] - 1e9 for r in rows]
    mean = sum(y) / len(y)
    want = 1 - 0.25 * len(y) / sum((v - mean) ** 2 for v in y)
    got = regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    assert abs(got.r2 - want) < 1e-6
    flat = spark.createDataFrame([(0.1, 0.2)] * 9, "y double, p double")
    assert regression_metrics(flat, "y", "p").first().r2 is None
