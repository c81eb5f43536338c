"""The sort-based as-of lookup against a brute-force loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from dockcast.config import CITY_RULES, HOUR, NO_HISTORY, OK, RunParams
from dockcast.operators.lookup import lag_lookup

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
HIST_SCHEMA = "city string, station_id int, ts timestamp_ntz, available int, reading_id long"
REQ_SCHEMA = "request_id long, city string, station_id int, requested_at timestamp_ntz, status string"


def brute(requests, history, unit):
    out = {}
    for rid, city, st, now, status in requests:
        rule = CITY_RULES.get(city)
        if status != OK or rule is None or not rule.lookups:
            continue
        vals = {}
        for lk in rule.lookups:
            start = now - dt.timedelta(seconds=lk.k * unit)
            win = sorted(
                (h for h in history if h[0] == city and h[1] == st and start < h[2] <= now),
                key=lambda h: (h[2], h[4]),
            )
            vals[lk.slot] = (win[0][3] if lk.kind == "earliest" else win[-1][3]) if win else None
        full = all(v is not None for v in vals.values())
        out[rid] = ([vals.get(i) for i in (1, 2, 3, 4)], OK if full else NO_HISTORY)
    return out


def run(spark, requests, history, params):
    r = spark.createDataFrame(requests, REQ_SCHEMA)
    h = spark.createDataFrame(history, HIST_SCHEMA)
    got = lag_lookup(r, h, params).collect()
    return {x.request_id: ([x.slot1, x.slot2, x.slot3, x.slot4], x.status) for x in got}, got


def test_edge_rows(spark):
    hours = lambda n: dt.timedelta(hours=n)
    history = [
        ("Barcelona", 1, T0 - hours(9), 90, 1),  # exactly at the 9 h cutoff: excluded (strict >)
        ("Barcelona", 1, T0 - hours(8), 80, 2),
        ("Barcelona", 1, T0 - hours(5), 50, 3),
        ("Barcelona", 1, T0 - hours(2), 20, 4),
        ("Barcelona", 1, T0 - hours(2), 21, 5),  # same timestamp: reading_id breaks the tie
        ("Barcelona", 1, T0, 10, 6),  # exactly now: included
        ("Barcelona", 1, T0 + hours(1), 99, 7),  # future: never used
        ("Barcelona", 2, T0 - hours(30), 5, 8),  # only old readings
        ("Santander", 3, T0 - hours(1), None, 9),  # null count -> no history
        ("Santander", 3, T0 - hours(4), 7, 10),
        ("Santander", 3, T0 - hours(9), 8, 11),
        ("Santander", 3, T0 - hours(14), 9, 12),
    ]
    requests = [
        (1, "Barcelona", 1, T0, OK),
        (2, "Barcelona", 2, T0, OK),
        (3, "Barcelona", 3, T0, OK),  # no readings at all
        (4, "Santander", 3, T0, OK),
        (5, "Malaga", 4, T0, OK),  # no lookups: zero lags
        (6, "Barcelona", 1, T0, "invalid_request"),  # not probed
    ]
    got, _ = run(spark, requests, history, RunParams(lag_unit=HOUR, bucket_units=60, lookup_plan="window"))
    assert got[1] == ([10, 20, 50, 80], OK)
    assert got[2][1] == NO_HISTORY and got[3][1] == NO_HISTORY
    assert got[4] == ([None, 7, 8, 9], NO_HISTORY)
    assert got[5] == ([0, 0, 0, 0], OK)
    assert got[6] == ([None, None, None, None], "invalid_request")
    assert got == {**brute(requests, history, HOUR), 5: got[5], 6: got[6]}


def test_random_against_brute_force_small_buckets(spark):
    """A hot station over many narrow buckets exercises the copy-to-previous-bucket path."""
    rnd = random.Random(7)
    history, requests = [], []
    for i in range(3000):
        city = rnd.choice(["Barcelona", "Santander"])
        st = 1 if rnd.random() < 0.4 else rnd.randint(1, 6)  # station 1 is hot
        ts = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 6))
        history.append((city, st, ts, rnd.randint(0, 40), i))
    for i in range(800):
        city = rnd.choice(["Barcelona", "Santander"])
        st = 1 if rnd.random() < 0.4 else rnd.randint(1, 6)
        now = T0 + dt.timedelta(hours=rnd.randint(0, 24 * 6), minutes=rnd.choice([0, 0, 17]))
        requests.append((i, city, st, now, OK))
    for b in (1, 2, 60):  # bucket width (clamped to the largest lookback)
        got, _ = run(spark, requests, history, RunParams(lag_unit=HOUR, bucket_units=b, lookup_plan="window"))
        assert got == brute(requests, history, HOUR), f"bucket_units={b}"


def test_one_shuffle_and_no_pair_join(spark):
    r = spark.createDataFrame([(1, "Barcelona", 1, T0, OK)], REQ_SCHEMA)
    h = spark.createDataFrame([("Barcelona", 1, T0, 1, 1)], HIST_SCHEMA)
    plan = lag_lookup(r, h, RunParams(lookup_plan="window"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan and "Cartesian" not in plan


def test_hot_station_is_split_over_many_shuffle_keys(spark):
    """One station with a third of all readings: its rows spread over time buckets."""
    from pyspark.sql import functions as F

    from dockcast.operators.lookup import reading_rows

    rnd = random.Random(11)
    rows = []
    for i in range(30000):
        st = 1 if i % 3 == 0 else rnd.randint(2, 200)
        ts = T0 + dt.timedelta(seconds=rnd.randint(0, 86400 * 90))
        rows.append(("Barcelona", st, ts, rnd.randint(0, 30), i))
    h = spark.createDataFrame(rows, HIST_SCHEMA)
    keyed = reading_rows(h, RunParams(lag_unit=HOUR, bucket_units=60))
    per_key = keyed.where("station_id = 1").groupBy("bucket").count()
    stats = per_key.agg(F.count("*").alias("keys"), F.max("count").alias("biggest"), F.sum("count").alias("copies")).first()
    assert stats.keys >= 30  # 90 days / 60 h buckets
    assert stats.biggest < 10000 / 20  # no task sees more than a small slice of the hot station
    assert stats.copies < 10000 * 1.2  # copies: readings within 9 h of a 60 h bucket start


def test_two_level_plan_against_brute_force(spark):
    """Dense hot station, repeated timestamps, unaligned request times."""
    rnd = random.Random(21)
    history, requests = [], []
    for i in range(4000):
        city = rnd.choice(["Barcelona", "Santander"])
        st = 1 if rnd.random() < 0.5 else rnd.randint(2, 5)
        base = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 4))
        ts = base if rnd.random() < 0.8 else T0 + dt.timedelta(hours=rnd.randint(0, 96))  # some equal ts
        history.append((city, st, ts, rnd.randint(0, 40) if rnd.random() > 0.01 else None, i))
    for i in range(600):
        city = rnd.choice(["Barcelona", "Santander"])
        st = 1 if rnd.random() < 0.5 else rnd.randint(1, 6)
        now = T0 + dt.timedelta(hours=rnd.randint(0, 96), minutes=rnd.choice([0, 7, 30]), seconds=rnd.choice([0, 13]))
        requests.append((i, city, st, now, OK))
    want = brute(requests, history, HOUR)
    for slot_seconds, bucket_units in ((60, 60), (600, 20), (3600, 1), (7, 16)):
        params = RunParams(lag_unit=HOUR, bucket_units=bucket_units, lookup_plan="two_level", slot_seconds=slot_seconds)
        got, _ = run(spark, requests, history, params)
        assert got == want, (slot_seconds, bucket_units)


def test_two_level_plan_shuffles_twice_no_join(spark):
    r = spark.createDataFrame([(1, "Barcelona", 1, T0, OK)], REQ_SCHEMA)
    h = spark.createDataFrame([("Barcelona", 1, T0, 1, 1)], HIST_SCHEMA)
    plan = lag_lookup(r, h, RunParams(lookup_plan="two_level"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan and "Cartesian" not in plan


def test_unknown_stations_anti_join(spark):
    from dockcast.operators.lookup import station_names, unknown_stations

    req = spark.createDataFrame([(1, "Malaga", 3), (2, "Malaga", 12), (3, "Barcelona", 3)],
                                "request_id long, city string, station_id int")
    dim = spark.createDataFrame([("Malaga", 3, "Av._de_Andalucia"), ("Barcelona", 4, "X")],
                                "city string, station_id int, name string")
    assert sorted(r.request_id for r in unknown_stations(req, dim).collect()) == [2, 3]
    named = {r.request_id: r.station_name for r in station_names(req, dim).collect()}
    assert named == {1: "Av._de_Andalucia", 2: None, 3: None}


def test_history_is_bounded_to_the_requests_time_range(spark):
    r = spark.createDataFrame([(1, "Barcelona", 1, T0, OK)], REQ_SCHEMA)
    h = spark.createDataFrame(
        [("Barcelona", 1, T0 - dt.timedelta(days=30), 5, 1), ("Barcelona", 1, T0 - dt.timedelta(hours=1), 7, 2)],
        HIST_SCHEMA,
    )
    from dockcast.operators.lookup import bound_history

    kept = bound_history(h, r, 9 * 3600).collect()
    assert [x.reading_id for x in kept] == [2]
    got, _ = run(spark, [(1, "Barcelona", 1, T0, OK)], [tuple(x) for x in h.collect()], RunParams(lag_unit=HOUR))
    assert got[1] == ([7, 7, 7, 7], OK)  # the 30-day-old reading is outside every window


def test_auto_plan_bounds_dense_tasks(spark):
    rnd = random.Random(5)
    history = [("Barcelona", 1, T0 + dt.timedelta(minutes=rnd.randint(0, 600)), rnd.randint(0, 9), i) for i in range(400)]
    requests = [(i, "Barcelona", 1, T0 + dt.timedelta(hours=rnd.randint(1, 10)), OK) for i in range(50)]
    got, _ = run(spark, requests, history, RunParams(lookup_plan="auto", slot_seconds=300))
    assert got == brute(requests, history, HOUR)


def test_shared_lookup_equals_the_plain_one(spark):
    """Half of the requests ask for one station at one time; others share keys with
    requests that aren't ok, or have null keys."""
    from dockcast.operators.lookup import shared_lag_lookup

    rnd = random.Random(3)
    history = [(rnd.choice(["Barcelona", "Santander"]), rnd.randint(1, 4), T0 - dt.timedelta(minutes=rnd.randint(0, 2000)), rnd.randint(0, 30), i) for i in range(500)]
    requests = [(i, "Barcelona", 1, T0, OK) for i in range(300)]
    for i in range(300, 600):
        city = rnd.choice(["Barcelona", "Santander", "Malaga", "Other", None])
        status = rnd.choice([OK, OK, "invalid_request", None])
        now = rnd.choice([T0, T0 - dt.timedelta(hours=3)])
        requests.append((i, city, rnd.choice([1, 2, 3, 9]) if status == OK else None, now, status))
    r = spark.createDataFrame(requests, REQ_SCHEMA).withColumn("extra", F.col("request_id") * 2)
    h = spark.createDataFrame(history, HIST_SCHEMA)
    for plan in ("window", "two_level"):
        params = RunParams(lookup_plan=plan)
        cols = ["request_id", "city", "station_id", "extra", "status", "slot1", "slot2", "slot3", "slot4"]
        a, b = (sorted(map(tuple, f(r, h, params).select(*cols).collect())) for f in (lag_lookup, shared_lag_lookup))
        assert a == b and len(a) == 600
    none = shared_lag_lookup(r.where("false"), h, RunParams())
    assert none.count() == 0
