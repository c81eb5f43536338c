"""The unrolled recursion against a plain row loop."""

import datetime as dt
import math
import random

from dockcast.config import CITY_RULES, OK
from dockcast.operators.forecast import MeanOfLags, ModelPredictor, forecast

SCHEMA = (
    "request_id long, city string, station_id int, id_station string, hour int, weekday int, month int, "
    "requested_at timestamp_ntz, status string, slot1 int, slot2 int, slot3 int, slot4 int"
)


def java_round(x):
    import struct

    f = struct.unpack("f", struct.pack("f", x))[0]
    return math.floor(f + 0.5)


def steps(rule, hour, now):
    if rule.step is None:
        return 1
    ahead = hour - now if now <= hour else hour + 24 - now
    n = ahead // rule.step + 1
    return 1 if n > rule.max_steps or n <= 1 else n


def loop(row, predict_one):
    """The reference's recursion for one request: predict, round, shift, repeat."""
    rule = CITY_RULES[row[1]]
    n = steps(rule, row[4], row[7].hour)
    lags = list(row[9:13])
    p = None
    for i in range(n):
        p = predict_one(rule, lags, row)
        if i < n - 1:
            lags = [java_round(p)] + lags[:3]
    return n, p


def mean_of_lags(rule, lags, row):
    slots = sorted(rule.slot_features)
    if not slots:
        return float((row[2] + row[5] + row[4]) % 11)
    return sum(lags[s - 1] for s in slots) / len(slots)


def sample_rows(n=300, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        city = rnd.choice(["Barcelona", "Santander", "Malaga"])
        now = dt.datetime(2024, 1, 5, rnd.randint(0, 23))
        lags = [rnd.randint(0, 40) for _ in range(4)] if city != "Malaga" else [0, 0, 0, 0]
        st = rnd.randint(1, 9)
        rows.append((i, city, st, str(st), rnd.randint(0, 23), rnd.randint(1, 7), 3, now, OK, *lags))
    return rows


def test_mean_of_lags_recursion_matches_row_loop(spark):
    rows = sample_rows()
    got = {r.request_id: (r.steps, r.prediction) for r in forecast(spark.createDataFrame(rows, SCHEMA), MeanOfLags()).collect()}
    for row in rows:
        n, p = loop(row, mean_of_lags)
        assert got[row[0]][0] == n
        assert math.isclose(got[row[0]][1], p, rel_tol=1e-12), row


def test_not_ok_rows_get_no_prediction(spark):
    rows = [(1, "Barcelona", 1, "1", 30, 1, 1, dt.datetime(2024, 1, 1, 5), "invalid_request", None, None, None, None)]
    r = forecast(spark.createDataFrame(rows, SCHEMA), MeanOfLags()).first()
    assert r.prediction is None and r.steps is None


def test_tree_recursion_matches_step_by_step_transform(spark):
    """Trees: the unrolled plan equals the reference loop of transform / round / shift."""
    from dockcast.plans.training import build_pipeline

    rnd = random.Random(5)
    models = {}
    for city in ("Barcelona", "Santander"):
        rule = CITY_RULES[city]
        data = []
        for _ in range(400):
            lags = [rnd.randint(0, 30) for _ in rule.train_lags]
            data.append((rnd.randint(1, 9), rnd.randint(0, 23), *lags, sum(lags) // len(lags) + rnd.randint(-2, 2)))
        cols = ["id_station", "hour", *rule.train_lags, rule.label]
        df = spark.createDataFrame(data, cols)
        models[city] = build_pipeline(rule, seed=1).fit(df)
    rows = [r for r in sample_rows(60, seed=9) if r[1] != "Malaga"]
    got = {
        r.request_id: r.prediction
        for r in forecast(spark.createDataFrame(rows, SCHEMA), ModelPredictor(models), {c: CITY_RULES[c] for c in models}).collect()
    }

    def tree_one(rule, lags, row):
        feats = {"id_station": row[2], "hour": row[4]}
        for slot, name in rule.slot_features.items():
            feats[name] = lags[slot - 1]
        one = spark.createDataFrame([tuple(feats[f] for f in rule.features)], list(rule.features))
        return models[rule.city].transform(one).first().prediction

    for row in rows[:12]:  # each step is a job, as in the reference - keep it short
        _, p = loop(row, tree_one)
        assert math.isclose(got[row[0]], p, rel_tol=1e-12), row


def test_models_see_rows_of_their_own_city_only(spark):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    def strict(city):  # fails on any other city's row
        sql = f"CASE WHEN city = '{city}' THEN 7.0D ELSE CAST(raise_error('row of another city') AS DOUBLE) END"
        return PipelineModel([SQLTransformer(statement=f"SELECT *, {sql} AS prediction FROM __THIS__")])

    now = dt.datetime(2024, 1, 5, 3)
    rows = sample_rows(30) + [
        (1000, "Nowhere", 1, "1", 5, 1, 1, now, "unknown_city", None, None, None, None),
        (1001, None, None, None, None, None, None, None, "malformed", None, None, None, None),
        (1002, "Malaga", None, "x", 5, 1, 1, now, "malformed", None, None, None, None),
    ]
    got = forecast(spark.createDataFrame(rows, SCHEMA), ModelPredictor({c: strict(c) for c in CITY_RULES})).collect()
    assert sorted(r.request_id for r in got) == sorted(r[0] for r in rows)
    assert all(r.prediction == (7.0 if r.status == OK else None) for r in got)
    assert all((r.steps is None) == (r.status != OK) for r in got)


def test_step_count_for_every_hour_pair(spark):
    """C10 + F3 for all target hours 0..29 (24+ are invalid) and every current hour."""
    from pyspark.sql import functions as F

    from dockcast.operators.forecast import steps_column

    rows = [(i, city, 1, "1", h, 1, 1, dt.datetime(2024, 1, 1, now), OK, 0, 0, 0, 0)
            for i, (city, h, now) in enumerate((c, h, n) for c in CITY_RULES for h in range(30) for n in range(24))]
    df = spark.createDataFrame(rows, SCHEMA).select("request_id", "city", "hour", "requested_at", steps_column().alias("n"))
    got = {r.request_id: r.n for r in df.collect()}
    for row in rows:
        assert got[row[0]] == steps(CITY_RULES[row[1]], row[4], row[7].hour), row[:8]


def test_rows_without_a_step_are_not_scored(spark):
    """a model is walked for the steps that a row has, not for every row and step."""
    from dockcast.config import RunParams
    from dockcast.plans.predict import predict
    from dockcast.sources.tables import events_history, events_requests

    class Once:
        def sql(self, rule):
            return "IF(status = 'ok' AND steps IS NOT NULL, 1D, CAST(raise_error('scored in vain') AS DOUBLE))"

    sf = "/root/testdata/sf0.001"
    got = predict(events_requests(spark, sf), events_history(spark, sf), Once(), RunParams(lag_unit=86400)).collect()
    assert {r.status for r in got} > {"ok"} and any(r.steps and r.steps > 1 for r in got)
