"""M8 over F1: how good the recursive forecast is at each of its steps.

Rolling origin: the forecast starts at the end of every slot of the time grid in which
a station has a reading, from the lags that were known then, and runs all its steps;
step ``i`` is compared with the reading of the slot that lies ``i`` recursion steps
ahead.  Origins whose lags are incomplete, and steps whose slot has no reading, are not
compared.  One lookup and one join by (city, station, slot), whatever the steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockcast.config import CITY_RULES, OK, CityRule, RunParams
from dockcast.operators.features import resample
from dockcast.operators.forecast import MeanOfLags, forecast_steps
from dockcast.operators.lookup import shared_lag_lookup


def backtest(history: DataFrame, params: RunParams, predictor=None, rules: dict[str, CityRule] = CITY_RULES) -> DataFrame:
    """(city, station_id, slot_ts, step, prediction, actual) of every comparison;
    ``predictor`` is an expression predictor."""
    rules = {c: r for c, r in rules.items() if r.lookups}
    grid = resample(history.where(F.col("city").isin(list(rules))), params.lag_unit).where("available IS NOT NULL")
    now = F.timestamp_add("SECOND", F.lit(params.lag_unit), "slot_ts")
    origins = grid.select(
        "city", "station_id", "slot_ts", now.alias("requested_at"), F.col("station_id").cast("string").alias("id_station"),
        F.hour(now).alias("hour"), F.dayofweek(now).alias("weekday"), F.month(now).alias("month"), F.lit(OK).alias("status"),
    )
    known = shared_lag_lookup(origins, history, params, rules).where(F.col("status") == OK)
    made = forecast_steps(known, predictor or MeanOfLags(), rules)
    seconds = F.expr("CASE city " + " ".join(f"WHEN '{c}' THEN {r.step * params.lag_unit}" for c, r in rules.items()) + " END")
    ahead = F.timestamp_add("SECOND", F.col("step") * seconds, F.col("slot_ts"))
    made = made.select("city", "station_id", F.col("slot_ts").alias("origin"), "step", "prediction", ahead.alias("slot_ts"))
    actual = grid.select("city", "station_id", "slot_ts", F.col("available").alias("actual"))
    joined = made.join(actual, ["city", "station_id", "slot_ts"])
    return joined.select("city", "station_id", F.col("origin").alias("slot_ts"), "step", "prediction", "actual")


def horizon_metrics(compared: DataFrame) -> DataFrame:
    """A2, A3 for each city and step: rows, rmse, mae and bias."""
    error = F.col("prediction") - F.col("actual")
    return compared.groupBy("city", "step").agg(
        F.count("*").alias("rows"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias")
    )
