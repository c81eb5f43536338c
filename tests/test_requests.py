"""Parse, validate, route - every quirk row of FIXTURES X1."""

import json

from dockcast.config import INVALID, MALFORMED, OK, UNKNOWN_CITY
from dockcast.operators.requests import extract_requests, route, validate_requests
from dockcast.sources.notifications import flatten_entities
from pyspark.sql import functions as F


def entity(station="1", weekday=3, hour=14, month=2, city="Barcelona", pid="p-1", sid="s-1", eid="e1", drop=()):
    attrs = {
        "idStation": station, "weekday": weekday, "hour": hour, "month": month,
        "city": city, "predictionId": pid, "socketId": sid,
    }
    e = {"id": eid, "type": "ReqPrediction"}
    for k, v in attrs.items():
        if k not in drop:
            e[k] = {"type": "Property", "value": v}
    return e


def notification(*ents):
    return json.dumps({"id": "n1", "type": "Notification", "data": list(ents)})


def parse(spark, lines):
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    ex = extract_requests(flatten_entities(raw), requested_at=F.lit("2024-01-01 10:00:00"))
    return validate_requests(ex)


def statuses(spark, ents):
    rows = parse(spark, [notification(e) for e in ents]).select("entity_id", "status").collect()
    return {r.entity_id: r.status for r in rows}


def test_station_ranges_per_city(spark):
    cases = {
        "b0": ("Barcelona", "0", INVALID), "b1": ("Barcelona", "1", OK), "b519": ("Barcelona", "519", OK),
        "b520": ("Barcelona", "520", INVALID), "b16": ("Barcelona", "16", OK),  # gap id passes the range test
        "s0": ("Santander", "0", INVALID), "s1": ("Santander", "1", OK), "s17": ("Santander", "17", OK),
        "s18": ("Santander", "18", INVALID), "m-1": ("Malaga", "-1", INVALID), "m0": ("Malaga", "0", OK),
        "m9": ("Malaga", "9", OK), "m10": ("Malaga", "10", INVALID),
    }
    got = statuses(spark, [entity(station=s, city=c, eid=k) for k, (c, s, _) in cases.items()])
    assert got == {k: want for k, (_, _, want) in cases.items()}


def test_hour_weekday_month_edges(spark):
    cases = {
        "h-1": dict(hour=-1), "h0": dict(hour=0), "h23": dict(hour=23), "h24": dict(hour=24),
        "w0": dict(weekday=0), "w1": dict(weekday=1), "w7": dict(weekday=7), "w8": dict(weekday=8),
        "m0": dict(month=0), "m1": dict(month=1), "m12": dict(month=12), "m13": dict(month=13),
    }
    got = statuses(spark, [entity(eid=k, **kw) for k, kw in cases.items()])
    ok = {"h0", "h23", "w1", "w7", "m1", "m12"}
    assert got == {k: OK if k in ok else INVALID for k in cases}


def test_unknown_city_missing_and_non_numeric(spark):
    got = statuses(
        spark,
        [
            entity(city="Sevilla", eid="unknown"),
            entity(city="0", eid="zero"),  # the entity's initial value
            entity(eid="missing", drop=("hour",)),
            entity(station="abc", eid="nonnum"),
            entity(station="1.0", eid="decimal"),
            entity(station=5, eid="number"),  # a JSON number is accepted like "5"
        ],
    )
    assert got == {
        "unknown": UNKNOWN_CITY, "zero": UNKNOWN_CITY, "missing": MALFORMED,
        "nonnum": MALFORMED, "decimal": MALFORMED, "number": OK,
    }


def test_broken_json_and_empty_batch_keep_or_drop_nothing_silently(spark):
    df = parse(spark, ["{not json", notification()])
    rows = df.collect()
    # broken JSON and an empty notification each leave one quarantined row
    assert len(rows) == 2
    assert {r.status for r in rows} == {UNKNOWN_CITY}
    empty = parse(spark, [])
    assert empty.count() == 0


def test_mixed_city_batch_routes_per_row_and_duplicates_kept(spark):
    df = parse(
        spark,
        [notification(entity(city="Barcelona", eid="a"), entity(city="Santander", eid="b", station="3"),
                      entity(city="Malaga", eid="c", station="4"), entity(city="Barcelona", eid="d", pid="p-1"))],
    )
    assert df.count() == 4
    assert {r.entity_id for r in route(df, "Barcelona").collect()} == {"a", "d"}
    assert {r.entity_id for r in route(df, "Santander").collect()} == {"b"}
    assert {r.entity_id for r in route(df, "Malaga").collect()} == {"c"}


def test_quote_in_socket_id_survives(spark):
    df = parse(spark, [notification(entity(sid='a"b', eid="q"))])
    assert df.first().socket_id == 'a"b'
