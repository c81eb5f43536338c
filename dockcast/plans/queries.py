"""Registered queries: (spark, sf_dir) -> DataFrame, each with a DuckDB twin.

Every query reads the driver's tables (or what Spark derives from them) in
full; none caps, samples or subsets rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.config import (
    BARCELONA,
    CADENCE_MINUTES,
    CITY_RULES,
    DAY,
    HOUR,
    MALAGA,
    RETENTION_HOURS,
    SANTANDER,
    RunParams,
)
from dockcast.functions import iso_utc, ntz_literal
from dockcast.operators import features as feat
from dockcast.operators.forecast import MeanOfLags, ModelPredictor, forecast
from dockcast.operators.lookup import SLOT_COLS, lag_lookup, shared_lag_lookup, station_names
from dockcast.operators.metrics import accuracy, regression_metrics
from dockcast.operators.requests import extract_requests, validate_requests
from dockcast.operators.responses import latest_per_key, shape_responses
from dockcast.operators.trees import TreePredictor, node_table, with_shared_prediction
from dockcast.plans import oracle
from dockcast.plans.predict import RESPONSE_INPUTS, predict, retain
from dockcast.plans.training import load_model, save_model, train_city
from dockcast.sources.history import docs_from_history, normalise_history
from dockcast.sources.notifications import entities_to_notifications, flatten_entities
from dockcast.sources.tables import events_history, events_requests, read_table

# cities whose requests read the history (the others never look it up)
LOOKUP_CITIES = [c for c, r in CITY_RULES.items() if r.lookups]

# The synthetic history holds ~0.4 readings per station and day, so the
# reference's hour windows are nearly always empty; the flagship stretches
# every window to days (same rules, larger unit) and a twin keeps hours.
FLAGSHIP_PARAMS = RunParams(lag_unit=DAY, bucket_units=60, slot_seconds=3600)
HOURLY_PARAMS = RunParams(lag_unit=HOUR, bucket_units=60)


def forecast_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every event as a request -> validated, looked up, forecast, shaped."""
    hist = events_history(spark, sf_dir, LOOKUP_CITIES)
    return predict(events_requests(spark, sf_dir), hist, params=FLAGSHIP_PARAMS)


def forecast_responses_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = events_history(spark, sf_dir, LOOKUP_CITIES)
    return predict(events_requests(spark, sf_dir), hist, params=HOURLY_PARAMS)


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed request columns and status."""
    v = validate_requests(events_requests(spark, sf_dir))
    return v.select("request_id", "city", "station_id", "weekday", "hour", "month", "status")


def lag_lookup_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four lag slots per request (windows in days), by the plan
    of one shuffle."""
    v = validate_requests(events_requests(spark, sf_dir))
    lk = lag_lookup(v, events_history(spark, sf_dir, LOOKUP_CITIES), replace(FLAGSHIP_PARAMS, lookup_plan="window"))
    return lk.select("request_id", "city", "station_id", "status", *SLOT_COLS)


def lag_lookup_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1-J3 through the slot-summary plan (for very dense / skewed histories)."""
    params = RunParams(lag_unit=DAY, bucket_units=60, lookup_plan="two_level", slot_seconds=3600)
    v = validate_requests(events_requests(spark, sf_dir))
    lk = lag_lookup(v, events_history(spark, sf_dir, LOOKUP_CITIES), params)
    return lk.select("request_id", "city", "station_id", "status", *SLOT_COLS)


def lag_lookup_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1-J3 with the plan that bounds every task."""
    params = RunParams(lag_unit=DAY, bucket_units=60, lookup_plan="auto", slot_seconds=3600)
    v = validate_requests(events_requests(spark, sf_dir))
    lk = lag_lookup(v, events_history(spark, sf_dir, LOOKUP_CITIES), params)
    return lk.select("request_id", "city", "station_id", "status", *SLOT_COLS)


def notification_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests landed as NGSI-LD notification JSON, parsed back."""
    req = events_requests(spark, sf_dir)
    notes = entities_to_notifications(req)
    ents = flatten_entities(notes)
    ex = extract_requests(
        ents, requested_at=F.lit("1970-01-01 00:00:00")
    )
    v = validate_requests(ex)
    return v.select(
        "entity_id", "socket_id", "prediction_id", "city", "station_id", "weekday", "hour", "month", "status"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "forecast_responses": forecast_responses,
    "forecast_responses_hourly": forecast_responses_hourly,
    "request_validation": request_validation,
    "lag_lookup_days": lag_lookup_days,
    "lag_lookup_two_level": lag_lookup_two_level,
    "lag_lookup_auto": lag_lookup_auto,
    "notification_roundtrip": notification_roundtrip,
}


def _validation_sql() -> str:
    return f"""
WITH req AS ({oracle.requests_sql()}), val AS ({oracle.validated_sql()})
SELECT request_id, city, station_id, weekday, hour, month, status0 AS status FROM val"""


def _lookup_sql(unit: int) -> str:
    return f"""
WITH req AS ({oracle.requests_sql()}), hist AS ({oracle.history_sql()}),
val AS ({oracle.validated_sql()}), lk AS ({oracle.lookups_sql(unit)}), lu AS ({oracle.looked_up_sql()})
SELECT request_id, city, station_id, status, slot1, slot2, slot3, slot4 FROM lu"""


def _notification_sql() -> str:
    return f"""
WITH req AS ({oracle.requests_sql()}), val AS ({oracle.validated_sql()})
SELECT 'urn:ngsi-ld:ReqPrediction:' || CAST(request_id AS VARCHAR) AS entity_id,
       socket_id, prediction_id, city, station_id, weekday, hour, month, status0 AS status FROM val"""


ORACLE_SQL: dict[str, str] = {
    "forecast_responses": oracle.prediction_pipeline_sql(DAY),
    "forecast_responses_hourly": oracle.prediction_pipeline_sql(HOUR),
    "request_validation": _validation_sql(),
    "lag_lookup_days": _lookup_sql(DAY),
    "lag_lookup_two_level": _lookup_sql(DAY),
    "lag_lookup_auto": _lookup_sql(DAY),
    "notification_roundtrip": _notification_sql(),
}


# --- features, profiles, training tables, metrics ---------------------------

TRAIN_UNIT = DAY  # same reason as FLAGSHIP_PARAMS: the synthetic history is sparse


def station_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean availability and trend sign per station."""
    return feat.station_profile(events_history(spark, sf_dir))


def training_table_barcelona(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 (+ D4 in ``comp``): label and 3/6/9-unit lags per station and slot."""
    hist = events_history(spark, sf_dir)
    t = feat.with_trend(feat.lag_training_table(hist, BARCELONA, TRAIN_UNIT), feat.station_profile(hist))
    return t.withColumn("slot", iso_utc("slot_ts")).drop("slot_ts")


def training_table_barcelona_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 in the reference's own unit: hours (most lags are null in this sparse history)."""
    hist = events_history(spark, sf_dir)
    t = feat.with_trend(feat.lag_training_table(hist, BARCELONA, HOUR), feat.station_profile(hist))
    return t.withColumn("slot", iso_utc("slot_ts")).drop("slot_ts")


def training_table_santander(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and 5/10/15/20-unit lags per station and slot."""
    return feat.lag_training_table(events_history(spark, sf_dir), SANTANDER, TRAIN_UNIT).drop("slot_ts")


def training_table_malaga(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 + C9: calendar columns and occupancy decile from lineitem."""
    return feat.malaga_training_table(read_table(spark, sf_dir, "lineitem"))


def _lag_table(spark, sf_dir, rule):
    return feat.lag_training_table(events_history(spark, sf_dir), rule, TRAIN_UNIT)


def _bike_baseline(spark: SparkSession, sf_dir: str, rule) -> tuple[DataFrame, Column]:
    """Rows of a bike training table with every lag set, and the mean-of-lags prediction."""
    t = _lag_table(spark, sf_dir, rule)
    lags = list(rule.train_lags)
    cond = F.lit(True)
    for c in lags:
        cond = cond & F.col(c).isNotNull()
    pred = sum((F.col(c).cast("double") for c in lags), F.lit(0.0)) / F.lit(float(len(lags)))
    return t.where(cond).withColumn("city", F.lit(rule.city)), pred


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A5 on the training tables for SQL baselines.

    Bikes: mean of the lag features (rows with every lag set).  Parking: the
    rounded mean class of the row's (name, weekday, hour) slot - a grouped
    aggregate joined back, never a window over a whole slot.
    """
    parts = []
    for rule in (BARCELONA, SANTANDER):
        rows, pred = _bike_baseline(spark, sf_dir, rule)
        m = regression_metrics(rows, "available_bikes", pred)
        parts.append(
            m.select(
                F.lit(rule.city).alias("city"),
                F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("rmse", "mae", "r2")])).alias("m"),
                "rows",
            ).select("city", "m.metric", "m.value", "rows")
        )
    mt = training_table_malaga(spark, sf_dir)
    keys = ["name", "weekday", "hour"]
    slot_mean = mt.groupBy(*keys).agg(F.round(F.avg("occupation")).alias("prediction"))
    # at most 10 x 7 x 24 slot means: AQE broadcasts them once measured
    acc = accuracy(mt.join(slot_mean, keys), "occupation", "prediction")
    parts.append(acc.select(F.lit(MALAGA.city).alias("city"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # sums of doubles depend on summation order; compare at 6 decimals
    return out.withColumn("value", F.round("value", 6))


def training_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 Barcelona rows with the baseline prediction, fully ordered."""
    t = _lag_table(spark, sf_dir, BARCELONA)
    pred = (F.col("three_before") + F.col("six_before") + F.col("nine_before")).cast("double") / F.lit(3.0)
    cols = ["available_bikes", "id_station", "three_before", "six_before", "nine_before"]
    return (
        t.select(pred.alias("prediction"), *cols, iso_utc("slot_ts").alias("slot"))
        .orderBy(*[F.col(c).asc_nulls_first() for c in cols], "slot")
        .limit(10)
    )


QUERIES.update(
    {
        "station_profile": station_profile,
        "training_table_barcelona": training_table_barcelona,
        "training_table_barcelona_hourly": training_table_barcelona_hourly,
        "training_table_santander": training_table_santander,
        "training_table_malaga": training_table_malaga,
        "baseline_metrics": baseline_metrics,
        "training_preview": training_preview,
    }
)


def _grid_sql(city: str, trunc: str) -> str:
    return f"""SELECT city, station_id, date_trunc('{trunc}', ts) AS slot_ts,
       arg_max({{'a': available}}, (ts, reading_id)).a AS available
  FROM hist WHERE city = '{city}' GROUP BY city, station_id, date_trunc('{trunc}', ts)"""


def _profile_sql() -> str:
    return """SELECT city, station_id, hour, avg_available, readings,
       CAST(CASE WHEN lead(hour) OVER w = hour + 1 THEN sign(lead(avg_available) OVER w - avg_available) ELSE 0 END AS INTEGER) AS trend
  FROM (SELECT city, station_id, CAST(hour(ts) AS INTEGER) AS hour, avg(available) AS avg_available,
               count(*) AS readings FROM hist GROUP BY city, station_id, CAST(hour(ts) AS INTEGER)) p
  WINDOW w AS (PARTITION BY city, station_id ORDER BY hour)"""


_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def _lag_table_sql(rule, trunc: str = "day") -> str:
    joins = " ".join(
        f"LEFT JOIN grid {n} ON {n}.station_id = g.station_id AND {n}.slot_ts = g.slot_ts - INTERVAL {k} {trunc.upper()}"
        for n, k in rule.train_lags.items()
    )
    lag_cols = ", ".join(f"{n}.available AS {n}" for n in rule.train_lags)
    return f"""SELECT g.available AS available_bikes, g.station_id AS id_station, g.slot_ts, {lag_cols}
  FROM grid g {joins} WHERE g.available IS NOT NULL"""


def _barcelona_table_sql(trunc: str = "day") -> str:
    return f"""
WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql('Barcelona', trunc)}),
prof AS ({_profile_sql()}), t AS ({_lag_table_sql(BARCELONA, trunc)})
SELECT t.available_bikes, t.id_station, CAST(hour(t.slot_ts) AS INTEGER) AS hour,
       t.three_before, t.six_before, t.nine_before, CAST(dayofweek(t.slot_ts) + 1 AS INTEGER) AS day,
       CAST(NULL AS INTEGER) AS blank, p.trend AS comp, strftime(t.slot_ts, {_ISO}) AS slot
FROM t LEFT JOIN prof p ON p.city = 'Barcelona' AND p.station_id = t.id_station AND p.hour = CAST(hour(t.slot_ts) AS INTEGER)"""


def _santander_table_sql() -> str:
    return f"""
WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql('Santander', 'day')}), t AS ({_lag_table_sql(SANTANDER)})
SELECT available_bikes, strftime(slot_ts, {_ISO}) AS modified, id_station,
       five_before, ten_before, fifteen_before, twenty_before FROM t"""


def _malaga_table_sql() -> str:
    return f"""
SELECT CAST(((l_suppkey % 10) + 10) % 10 AS INTEGER) AS name,
       CAST(floor(50 - l_quantity) AS INTEGER) AS availableSpotNumber,
       strftime(ts, {_ISO}) AS timestamp,
       CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday,
       50 AS total,
       CAST(day(ts) AS INTEGER) AS day,
       CAST(month(ts) AS INTEGER) AS month,
       CAST(hour(ts) AS INTEGER) AS hour,
       CAST(minute(ts) AS INTEGER) AS minute,
       CAST(hour(ts) * 2 + floor(minute(ts) / 30) AS INTEGER) AS hour_interval,
       strftime(ts, '%H:%M') AS time,
       CAST(floor(50 - l_quantity) AS INTEGER) / 50.0 AS available,
       CAST(round((1.0 - CAST(floor(50 - l_quantity) AS INTEGER) / 50.0) * 10) AS INTEGER) AS occupation
FROM (SELECT *, l_shipdate + to_minutes(CAST((l_orderkey * 37 + l_linenumber * 11) % 1440 AS INTEGER)) AS ts FROM lineitem) l"""


def _metrics_sql() -> str:
    def reg(rule, table_sql):
        lags = list(rule.train_lags)
        pred = "(" + " + ".join(f"CAST({c} AS DOUBLE)" for c in lags) + f") / {float(len(lags))}"
        cond = " AND ".join(f"{c} IS NOT NULL" for c in lags)
        return f"""SELECT '{rule.city}' AS city, count(*) AS rows,
              sqrt(sum(({pred} - available_bikes) * ({pred} - available_bikes)) / count(*)) AS rmse,
              avg(abs({pred} - available_bikes)) AS mae,
              CASE WHEN min(available_bikes) < max(available_bikes) THEN
                1.0 - avg(({pred} - available_bikes) * ({pred} - available_bikes)) / var_pop(available_bikes) END AS r2
            FROM ({table_sql}) x WHERE {cond}"""

    bcn = f"WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql('Barcelona', 'day')}) {_lag_table_sql(BARCELONA)}"
    snt = f"WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql('Santander', 'day')}) {_lag_table_sql(SANTANDER)}"
    return f"""
WITH r AS ({reg(BARCELONA, bcn)} UNION ALL {reg(SANTANDER, snt)}),
mt AS ({_malaga_table_sql()}),
sm AS (SELECT name, weekday, hour, round(avg(occupation)) AS prediction FROM mt GROUP BY name, weekday, hour),
acc AS (SELECT count(*) AS rows, avg(CASE WHEN CAST(sm.prediction AS DOUBLE) = CAST(mt.occupation AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM mt JOIN sm USING (name, weekday, hour))
SELECT city, metric, ROUND(value, 6) AS value, rows FROM (
SELECT city, 'rmse' AS metric, rmse AS value, rows FROM r
UNION ALL SELECT city, 'mae', mae, rows FROM r
UNION ALL SELECT city, 'r2', r2, rows FROM r
UNION ALL SELECT 'Malaga', 'accuracy', accuracy, rows FROM acc) m"""


def _preview_sql() -> str:
    return f"""
WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql('Barcelona', 'day')}), t AS ({_lag_table_sql(BARCELONA)})
SELECT CAST(three_before + six_before + nine_before AS DOUBLE) / 3.0 AS prediction,
       available_bikes, id_station, three_before, six_before, nine_before, strftime(slot_ts, {_ISO}) AS slot
FROM t ORDER BY available_bikes NULLS FIRST, id_station NULLS FIRST, three_before NULLS FIRST,
         six_before NULLS FIRST, nine_before NULLS FIRST, slot LIMIT 10"""


ORACLE_SQL.update(
    {
        "station_profile": f"WITH hist AS ({oracle.history_sql()}) {_profile_sql()}",
        "training_table_barcelona": _barcelona_table_sql(),
        "training_table_barcelona_hourly": _barcelona_table_sql("hour"),
        "training_table_santander": _santander_table_sql(),
        "training_table_malaga": _malaga_table_sql(),
        "baseline_metrics": _metrics_sql(),
        "training_preview": _preview_sql(),
    }
)


# --- sources, dimension lookup, snapshots -----------------------------------


def history_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History landed in the two raw document layouts, normalised back."""
    hist = events_history(spark, sf_dir)
    norm = normalise_history(docs_from_history(hist, "Barcelona"), docs_from_history(hist, "Santander"))
    return norm.select("city", "station_id", iso_utc("ts").alias("ts"), "available", "reading_id")


def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 24 h before the newest reading, per station and 30-minute slot.

    The cut-off is read once (one aggregate) and applied as a literal, so it
    reaches the Parquet scan as a pushed filter.
    """
    hist = events_history(spark, sf_dir)
    as_of = read_table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    kept = retain(hist, as_of)
    return kept.groupBy("city", "station_id", F.window("ts", f"{CADENCE_MINUTES} minutes").start.cast("timestamp_ntz").alias("slot_ts")).agg(
        F.count(F.lit(1)).alias("readings"),
        F.max_by("available", F.struct("ts", "reading_id")).alias("last_available"),
    ).select("city", "station_id", iso_utc("slot_ts").alias("slot"), "readings", "last_available")


def stations_from_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension: bike stations from supplier (key, name, city by nation
    parity); Malaga car parks from their fixed name list."""
    from dockcast.sources.files import malaga_stations

    s = read_table(spark, sf_dir, "supplier")
    city = F.when(F.pmod("s_nationkey", F.lit(2)) == 0, "Barcelona").otherwise("Santander")
    bikes = s.select(city.alias("city"), F.col("s_suppkey").cast("int").alias("station_id"), F.col("s_name").alias("name"))
    return bikes.unionByName(malaga_stations(spark))


def station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station name per request (left join on city + station; AQE broadcasts the names once measured)."""
    v = validate_requests(events_requests(spark, sf_dir))
    j = station_names(v, stations_from_supplier(spark, sf_dir))
    return j.select("request_id", "city", "station_id", "status", "station_name")


def response_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response entity of each station as last written (latest request
    wins).  The winner depends on the request alone, so it is picked first and
    only the winners are looked up and scored."""
    v = validate_requests(events_requests(spark, sf_dir)).select(*RESPONSE_INPUTS)
    key = F.coalesce(F.col("station_id").cast("string"), F.col("id_station"))
    last = latest_per_key(v.withColumn("answer_key", key), ["city", "answer_key"], ["requested_at", "request_id"]).drop("answer_key")
    scored = forecast(shared_lag_lookup(last, events_history(spark, sf_dir, LOOKUP_CITIES), FLAGSHIP_PARAMS), MeanOfLags())
    shaped = shape_responses(scored, extra=("requested_at",))
    return shaped.select(
        "city", "idStation", "predictionValue", "predictionId", "status",
        iso_utc("requested_at").alias("produced_at"), "request_id",
    )


QUERIES.update(
    {
        "history_normalise": history_normalise,
        "history_retention": history_retention,
        "station_lookup": station_lookup,
        "response_snapshot": response_snapshot,
    }
)


def _stations_sql() -> str:
    from dockcast.config import MALAGA_STATION_NAMES

    malaga = " UNION ALL ".join(f"SELECT 'Malaga', {i}, '{n}'" for i, n in enumerate(MALAGA_STATION_NAMES))
    return f"""SELECT CASE WHEN ((s_nationkey % 2) + 2) % 2 = 0 THEN 'Barcelona' ELSE 'Santander' END AS city,
              CAST(s_suppkey AS INTEGER) AS station_id, s_name AS name FROM supplier
              UNION ALL {malaga}"""


def _snapshot_sql() -> str:
    full = oracle.prediction_pipeline_sql(DAY, with_lags=False)
    # reuse the pipeline, keeping requested_at for the ordering
    full = full.replace(
        "weekday, hour, month, city, status, CAST(CASE WHEN status = 'ok' THEN steps END AS INTEGER) AS steps",
        "weekday, hour, month, city, status, CAST(CASE WHEN status = 'ok' THEN steps END AS INTEGER) AS steps, requested_at",
    )
    return f"""
WITH resp AS ({full})
SELECT city, idStation, predictionValue, predictionId, status, strftime(requested_at, {_ISO}) AS produced_at, request_id
FROM resp
QUALIFY row_number() OVER (PARTITION BY city, idStation ORDER BY requested_at DESC, request_id DESC) = 1"""


ORACLE_SQL.update(
    {
        "history_normalise": f"""WITH hist AS ({oracle.history_sql()})
SELECT city, station_id, strftime(ts, {_ISO}) AS ts, available, reading_id FROM hist
WHERE city IN ('Barcelona', 'Santander')""",
        "history_retention": f"""WITH hist AS ({oracle.history_sql()}),
kept AS (SELECT * FROM hist WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND ts <= (SELECT max(ts) FROM events))
SELECT city, station_id, strftime(time_bucket(INTERVAL {CADENCE_MINUTES} MINUTE, ts), {_ISO}) AS slot, count(*) AS readings,
       arg_max({{'a': available}}, (ts, reading_id)).a AS last_available
FROM kept GROUP BY city, station_id, time_bucket(INTERVAL {CADENCE_MINUTES} MINUTE, ts)""",
        "station_lookup": f"""WITH req AS ({oracle.requests_sql()}), val AS ({oracle.validated_sql()}), st AS ({_stations_sql()})
SELECT v.request_id, v.city, v.station_id, v.status0 AS status, st.name AS station_name
FROM val v LEFT JOIN st ON st.city = v.city AND st.station_id = v.station_id""",
        "response_snapshot": _snapshot_sql(),
    }
)


# --- trained trees (rows-only: trees are not SQL) ---------------------------


def _tables_for_training(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "Barcelona": training_table_barcelona(spark, sf_dir),
        "Santander": training_table_santander(spark, sf_dir),
        "Malaga": training_table_malaga(spark, sf_dir),
    }


def train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M8: fit each city's pipeline on its 80 % hash split, metrics on the rest."""
    out = None
    for city, table in _tables_for_training(spark, sf_dir).items():
        m = train_city(table, CITY_RULES[city]).metrics
        out = m if out is None else out.unionByName(m)
    return out


def forecast_with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 + M7 + S8 + S9 with the fitted trees, saved and read back as expressions:
    every request scored in one plan, cities and steps in one chain of projections."""
    paths = {c: _saved(spark, train_city(t, CITY_RULES[c]).model, c) for c, t in _tables_for_training(spark, sf_dir).items()}
    hist = events_history(spark, sf_dir, LOOKUP_CITIES)
    return predict(events_requests(spark, sf_dir), hist, TreePredictor.load(spark, paths), FLAGSHIP_PARAMS)


def _saved(spark: SparkSession, model: PipelineModel, name: str) -> str:
    path = _scratch(spark, f"model-{name}")
    save_model(model, path)
    return path


QUERIES.update({"train_evaluate": train_evaluate, "forecast_with_models": forecast_with_models})


# --- the same training and scoring code, on inputs whose result SQL can state -

# A tree that may split its few feature values fully predicts the mean (bikes) or
# the most frequent class, ties to the smaller (parking), of each value's rows.
_STATION_TREE = {"features": ("station_group",), "tree_depth": 9}
FULL_TREE_RULES = {
    "Barcelona": replace(BARCELONA, **_STATION_TREE),
    "Santander": replace(SANTANDER, **_STATION_TREE),
    "Malaga": replace(MALAGA, features=("name", "weekday"), tree_depth=15, num_trees=1),
}


def _full_trees(spark: SparkSession, sf_dir: str) -> dict:
    """Every city's tree, fitted on the rows whose split key mod 10 is below 8."""
    out = {}
    for rule in (BARCELONA, SANTANDER):
        t = _lag_table(spark, sf_dir, rule).withColumn("station_group", F.pmod("id_station", F.lit(10)))
        key = F.date_diff("slot_ts", F.lit("1970-01-01").cast("date")) + F.col("id_station")
        out[rule.city] = train_city(t, FULL_TREE_RULES[rule.city], split_key=key)
    key = F.col("day") * 7 + F.col("minute") + F.col("availableSpotNumber")
    out["Malaga"] = train_city(training_table_malaga(spark, sf_dir), FULL_TREE_RULES["Malaga"], split_key=key)
    return out


def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows scored by trees that were saved and loaded."""
    out = None
    for city, t in _full_trees(spark, sf_dir).items():
        path = _scratch(spark, f"tree-{city}")
        save_model(t.model, path)
        rows = t.test_predictions.drop("features", "rawPrediction", "probability", "prediction")
        rule = FULL_TREE_RULES[city]
        scored = load_model(path).transform(rows).select(
            F.lit(city).alias("city"),
            F.col(rule.features[0]).alias("grp"),
            (F.col("weekday") if "weekday" in rule.features else F.lit(0)).alias("weekday"),
            F.col(rule.label).alias("label"),
            F.round("prediction", 6).alias("prediction"),
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def tree_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M8: metrics of the same trees on the held-out rows."""
    out = None
    for t in _full_trees(spark, sf_dir).values():
        out = t.metrics if out is None else out.unionByName(t.metrics)
    return out.withColumn("value", F.round("value", 6))


def forecast_model_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast through saved and loaded pipelines, which
    state the baseline over the renamed model features."""
    formula = {
        r.city: f"({' + '.join(r.slot_features.values())}) / {float(len(r.slot_features))}D"
        if r.slot_features
        else "CAST(pmod(name + weekday + hour, 11) AS DOUBLE)"
        for r in CITY_RULES.values()
    }
    models = {}
    for city, sql in formula.items():
        path = _scratch(spark, f"formula-{city}")
        save_model(PipelineModel([SQLTransformer(statement=f"SELECT *, {sql} AS prediction FROM __THIS__")]), path)
        models[city] = load_model(path)
    hist = events_history(spark, sf_dir, LOOKUP_CITIES)
    return predict(events_requests(spark, sf_dir), hist, ModelPredictor(models), FLAGSHIP_PARAMS)


# Availability in levels of this many bikes: few enough values for a tree to part all.
LEVEL = 25
LAG_TREE_RULES = {
    "Barcelona": replace(BARCELONA, features=("three_before",), tree_depth=25),
    "Santander": replace(SANTANDER, features=("five_before",), tree_depth=25),
    "Malaga": FULL_TREE_RULES["Malaga"],
}


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = events_history(spark, sf_dir, LOOKUP_CITIES)
    return hist.withColumn("available", F.floor(F.col("available") / LEVEL).cast("int"))


def _malaga_key() -> Column:
    return F.col("day") * 7 + F.col("minute") + F.col("availableSpotNumber")


def forecast_with_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive forecast by trees that were trained,
    saved and read back as expressions.  Each bike tree knows the first lag alone, so
    that every step follows from the rounded answer of the step before."""
    hist = _levels(spark, sf_dir)
    paths = {}
    for city in LOOKUP_CITIES:
        t = feat.lag_training_table(hist, LAG_TREE_RULES[city], TRAIN_UNIT)
        key = F.date_diff("slot_ts", F.lit("1970-01-01").cast("date")) + F.col("id_station")
        paths[city] = _saved(spark, train_city(t, LAG_TREE_RULES[city], split_key=key).model, city)
    parking = train_city(training_table_malaga(spark, sf_dir), LAG_TREE_RULES["Malaga"], split_key=_malaga_key())
    paths["Malaga"] = _saved(spark, parking.model, "Malaga")
    trees = TreePredictor.load(spark, paths)
    return predict(events_requests(spark, sf_dir), hist, trees, FLAGSHIP_PARAMS, LAG_TREE_RULES)


FOREST_RULE = replace(MALAGA, features=("name", "weekday"), tree_depth=15)


def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest of 100 bootstrapped trees, saved and scored as an
    expression on the held-out rows.  Every training row has its group's most frequent
    class as label, which all trees must find, whatever rows their bootstraps hold."""
    rows = training_table_malaga(spark, sf_dir).withColumn("train", F.pmod(_malaga_key(), F.lit(10)) < 8)
    counts = rows.where("train").groupBy("name", "weekday", "occupation").count()
    common = counts.groupBy("name", "weekday").agg(
        F.max_by("occupation", F.struct("count", -F.col("occupation"))).alias("common")  # ties: the smaller class
    )
    t = rows.join(common, ["name", "weekday"])
    taught = t.withColumn("occupation", F.when(F.col("train"), F.col("common")).otherwise(F.col("occupation"))).drop("common")
    trained = train_city(taught, FOREST_RULE, split_key=_malaga_key())
    held = trained.test_predictions.select("name", "weekday", "occupation")
    scored = with_shared_prediction(held, node_table(spark, _saved(spark, trained.model, "forest")))
    return scored.select("name", "weekday", F.col("occupation").alias("label"), "prediction")


QUERIES.update(
    {
        "tree_scores": tree_scores,
        "tree_metrics": tree_metrics,
        "forecast_model_path": forecast_model_path,
        "forecast_with_trees": forecast_with_trees,
        "forest_scores": forest_scores,
    }
)


def _tree_ctes() -> str:
    """Held-out rows with the mean or first most frequent class of their training group."""
    parts = []
    for rule in (BARCELONA, SANTANDER):
        c = rule.city
        parts.append(f"""t_{c} AS (WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql(c, 'day')})
  SELECT available_bikes AS label, id_station % 10 AS grp, 0 AS weekday,
         (date_diff('day', DATE '1970-01-01', CAST(slot_ts AS DATE)) + id_station) % 10 < 8 AS train
  FROM ({_lag_table_sql(rule)}) x),
s_{c} AS (SELECT '{c}' AS city, t.grp, t.weekday, t.label, p.prediction FROM t_{c} t
  JOIN (SELECT grp, avg(label) AS prediction FROM t_{c} WHERE train GROUP BY grp) p USING (grp) WHERE NOT train)""")
    parts.append(f"""t_Malaga AS (SELECT name AS grp, weekday, occupation AS label,
         (day * 7 + minute + availableSpotNumber) % 10 < 8 AS train FROM ({_malaga_table_sql()}) x),
c_Malaga AS (SELECT grp, weekday, label, row_number() OVER (PARTITION BY grp, weekday ORDER BY count(*) DESC, label) AS place
  FROM t_Malaga WHERE train GROUP BY grp, weekday, label),
s_Malaga AS (SELECT 'Malaga' AS city, t.grp, t.weekday, t.label, CAST(c.label AS DOUBLE) AS prediction
  FROM t_Malaga t JOIN c_Malaga c USING (grp, weekday) WHERE place = 1 AND NOT train)""")
    return "WITH " + ",\n".join(parts)


def _lag_trees_sql() -> str:
    """The forecast whose step is the mean label of the lag's group: a tree parts two
    neighbouring values in their middle, so other lags go to the nearer one."""
    hist = f"SELECT * REPLACE (CAST(available // {LEVEL} AS INTEGER) AS available) FROM ({oracle.history_sql()}) h"
    ctes, steps = [_lag_groups_sql(city) for city in LOOKUP_CITIES], {}
    for city in LOOKUP_CITIES:
        steps[city] = f"list_filter((SELECT groups FROM l_{city}), lambda g: s1 <= g.upto)[1].p"
    ctes.append(f"""c_Malaga AS (SELECT name, weekday, occupation, row_number() OVER (PARTITION BY name, weekday ORDER BY count(*) DESC, occupation) AS place
  FROM ({_malaga_table_sql()}) x WHERE (day * 7 + minute + availableSpotNumber) % 10 < 8 GROUP BY name, weekday, occupation)""")
    steps["Malaga"] = "(SELECT CAST(occupation AS DOUBLE) FROM c_Malaga m WHERE place = 1 AND m.name = station_id AND m.weekday = z.weekday)"
    return oracle.prediction_pipeline_sql(DAY, history=hist, more=ctes, step=lambda rule: steps[rule.city])


def _lag_groups_sql(city: str) -> str:
    """CTEs of a city's lag groups with their mean labels, and of one list of them."""
    rule = LAG_TREE_RULES[city]
    lag = rule.features[0]
    return f"""g_{city} AS (WITH grid AS ({_grid_sql(city, 'day')}), t AS ({_lag_table_sql(rule)})
  SELECT {lag} AS x, avg(available_bikes) AS p FROM t WHERE {lag} IS NOT NULL
  AND (date_diff('day', DATE '1970-01-01', CAST(slot_ts AS DATE)) + id_station) % 10 < 8 GROUP BY {lag}),
l_{city} AS (SELECT list({{'upto': coalesce(upto, 1e9), 'p': p}} ORDER BY x) AS groups
  FROM (SELECT *, (x + lead(x) OVER (ORDER BY x)) / 2.0 AS upto FROM g_{city}) z)"""


ORACLE_SQL.update(
    {
        "tree_scores": _tree_ctes()
        + " SELECT city, grp, weekday, label, round(prediction, 6) AS prediction FROM ("
        + " UNION ALL ".join(f"SELECT * FROM s_{c}" for c in CITY_RULES)
        + ") s",
        "tree_metrics": _tree_ctes()
        + """, bikes AS (SELECT city, count(*) AS rows, sqrt(avg((prediction - label) * (prediction - label))) AS rmse,
    avg(abs(prediction - label)) AS mae, 1 - avg((prediction - label) * (prediction - label)) / var_pop(label) AS r2
  FROM (SELECT * FROM s_Barcelona UNION ALL SELECT * FROM s_Santander) s GROUP BY city)
SELECT city, metric, round(value, 6) AS value, rows FROM (
  SELECT city, 'rmse' AS metric, rmse AS value, rows FROM bikes UNION ALL SELECT city, 'mae', mae, rows FROM bikes
  UNION ALL SELECT city, 'r2', r2, rows FROM bikes
  UNION ALL SELECT city, 'accuracy', avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), count(*) FROM s_Malaga GROUP BY city) m""",
        "forecast_model_path": oracle.prediction_pipeline_sql(DAY),
        "forest_scores": _tree_ctes() + " SELECT grp AS name, weekday, label, prediction FROM s_Malaga",
        "forecast_with_trees": _lag_trees_sql(),
    }
)


# --- category indexing (M4) and the CSV connectors (S6, S7) -----------------


def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the StringIndexer of the parking pipeline, fitted on the whole
    Malaga table; its value -> index mapping as rows (frequency descending,
    ties alphabetical)."""
    from pyspark.ml.feature import StringIndexer

    table = training_table_malaga(spark, sf_dir)
    model = StringIndexer(
        inputCols=["name", "weekday"], outputCols=["name_index", "weekday_index"], handleInvalid="keep"
    ).fit(table)
    indexed = model.transform(table)
    parts = [
        indexed.groupBy(F.col(c).cast("string").alias("value"), F.col(f"{c}_index").cast("int").alias("idx"))
        .count()
        .select(F.lit(c).alias("col"), "value", "idx", "count")
        for c in ("name", "weekday")
    ]
    return parts[0].unionByName(parts[1])


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from dockcast.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def training_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Santander training table written as CSV (header, comma) and read
    back through the declared-schema reader with quarantine."""
    from dockcast.sources.files import read_training_csv, split_quarantine

    path = _scratch(spark, "train-santander-csv")
    training_table_santander(spark, sf_dir).write.option("header", "true").csv(path)
    clean, _bad = split_quarantine(read_training_csv(spark, path, "Santander"))
    return clean


def stations_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station dimension written as the combined CSV layout
    (id, station_id, quoted name, City) and read back."""
    from dockcast.sources.files import read_stations

    path = _scratch(spark, "stations-csv")
    dim = stations_from_supplier(spark, sf_dir)
    dim.select(
        F.pmod(F.xxhash64("city", "station_id"), F.lit(2**31 - 1)).cast("int").alias("id"),
        "station_id",
        F.concat(F.col("name"), F.lit(", "), F.col("city")).alias("name"),
        F.col("city").alias("City"),
    ).write.option("header", "true").option("quoteAll", "true").csv(path)
    return read_stations(spark, path)


QUERIES.update(
    {
        "category_index": category_index,
        "training_csv_roundtrip": training_csv_roundtrip,
        "stations_csv_roundtrip": stations_csv_roundtrip,
    }
)

ORACLE_SQL.update(
    {
        "category_index": f"""
WITH t AS ({_malaga_table_sql()}),
c AS (SELECT 'name' AS col, CAST(name AS VARCHAR) AS value, count(*) AS count FROM t GROUP BY CAST(name AS VARCHAR)
      UNION ALL
      SELECT 'weekday', CAST(weekday AS VARCHAR), count(*) FROM t GROUP BY CAST(weekday AS VARCHAR))
SELECT col, value, CAST(row_number() OVER (PARTITION BY col ORDER BY count DESC, value ASC) - 1 AS INTEGER) AS idx, count
FROM c""",
        "training_csv_roundtrip": _santander_table_sql(),
        "stations_csv_roundtrip": f"""
SELECT city, station_id, name || ', ' || city AS name FROM ({_stations_sql()}) s""",
    }
)


# --- S5 cadence check -------------------------------------------------------


def history_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per known station, over the 48 half-hour slots up to the latest
    reading's slot, readings, filled slots and missing slots (0 to 48; a silent
    station misses all).  One pass over the history: slots are counted per
    (city, station, slot) - partially aggregated, so a hot station is cheap -
    with all older readings of a station as one further group."""
    hist = events_history(spark, sf_dir)
    as_of = read_table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    slots = RETENTION_HOURS * 60 // CADENCE_MINUTES
    if as_of is None:
        return hist.groupBy("city", "station_id").agg(*[F.count("ts").alias(c) for c in ("readings", "filled_slots", "missing_slots")])
    # the grid counts from midnight; the last slot is the one that holds as_of
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    end = day + ((as_of - day) // dt.timedelta(minutes=CADENCE_MINUTES) + 1) * dt.timedelta(minutes=CADENCE_MINUTES)
    start = ntz_literal(end - dt.timedelta(hours=RETENTION_HOURS))
    slot = F.when((F.col("ts") >= start) & (F.col("ts") < ntz_literal(end)), F.window("ts", f"{CADENCE_MINUTES} minutes").start)
    per_slot = hist.groupBy("city", "station_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return per_slot.groupBy("city", "station_id").agg(
        F.sum(F.when(F.col("slot").isNotNull(), F.col("n")).otherwise(0)).alias("readings"),
        F.count("slot").alias("filled_slots"),
        (F.lit(slots) - F.count("slot")).alias("missing_slots"),
    )


QUERIES["history_cadence"] = history_cadence
ORACLE_SQL["history_cadence"] = f"""WITH hist AS ({oracle.history_sql()}),
grid AS (SELECT unnest(generate_series(last_slot - INTERVAL {RETENTION_HOURS * 60 - CADENCE_MINUTES} MINUTE, last_slot, INTERVAL {CADENCE_MINUTES} MINUTE)) AS slot
         FROM (SELECT time_bucket(INTERVAL {CADENCE_MINUTES} MINUTE, max(ts)) AS last_slot FROM events)),
stations AS (SELECT DISTINCT city, station_id FROM hist),
counted AS (SELECT city, station_id, slot, count(ts) AS n
            FROM stations CROSS JOIN grid LEFT JOIN hist USING (city, station_id)
            WHERE ts >= slot AND ts < slot + INTERVAL {CADENCE_MINUTES} MINUTE GROUP BY city, station_id, slot)
SELECT city, station_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS readings, count(slot) AS filled_slots,
       (SELECT count(*) FROM grid) - count(slot) AS missing_slots
FROM stations LEFT JOIN counted USING (city, station_id) GROUP BY city, station_id"""


# --- A2-A4 per station ------------------------------------------------------


def baseline_metrics_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A4 grouped by (city, station) in one pass: the per-station scores
    of the mean-of-lags baseline on the bike training tables.  r2 is null for
    a station whose labels are constant."""
    parts = []
    for rule in (BARCELONA, SANTANDER):
        rows, pred = _bike_baseline(spark, sf_dir, rule)
        parts.append(regression_metrics(rows, "available_bikes", pred, by=["city", "id_station"]))
    out = parts[0].unionByName(parts[1])
    return out.select("city", "id_station", "rows", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


QUERIES["baseline_metrics_by_station"] = baseline_metrics_by_station


def _station_metrics_sql() -> str:
    def reg(rule, table_sql):
        lags = list(rule.train_lags)
        pred = "(" + " + ".join(f"CAST({c} AS DOUBLE)" for c in lags) + f") / {float(len(lags))}"
        cond = " AND ".join(f"{c} IS NOT NULL" for c in lags)
        y = "CAST(available_bikes AS DOUBLE)"
        return f"""SELECT '{rule.city}' AS city, id_station, count(*) AS rows,
              ROUND(sqrt(sum(({pred} - {y}) * ({pred} - {y})) / count(*)), 6) AS rmse,
              ROUND(avg(abs({pred} - {y})), 6) AS mae,
              CASE WHEN min({y}) < max({y}) THEN
                ROUND(1.0 - avg(({pred} - {y}) * ({pred} - {y})) / var_pop({y}), 6) END AS r2
            FROM ({table_sql}) x WHERE {cond} GROUP BY id_station"""

    bcn = f"WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql('Barcelona', 'day')}) {_lag_table_sql(BARCELONA)}"
    snt = f"WITH hist AS ({oracle.history_sql()}), grid AS ({_grid_sql('Santander', 'day')}) {_lag_table_sql(SANTANDER)}"
    return f"{reg(BARCELONA, bcn)} UNION ALL {reg(SANTANDER, snt)}"


ORACLE_SQL["baseline_metrics_by_station"] = _station_metrics_sql()
