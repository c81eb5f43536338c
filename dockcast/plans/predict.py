"""Online prediction, batch form: requests + history -> shaped responses.

Per batch: validate (written once) -> as-of lag lookup of the distinct keys, joined
back -> unrolled recursive forecast (narrow) -> response shaping (narrow).  The
same function serves the stream through ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockcast.config import CITY_RULES, RETENTION_HOURS, CityRule, RunParams
from dockcast.functions import minus_seconds, ntz_literal
from dockcast.operators.forecast import MeanOfLags, forecast
from dockcast.operators.lookup import SLOT_COLS, shared_lag_lookup
from dockcast.operators.requests import validate_requests
from dockcast.operators.responses import shape_responses


RESPONSE_INPUTS = (
    "request_id", "socket_id", "prediction_id", "city", "id_station", "station_id",
    "weekday", "hour", "month", "requested_at", "status",
)


def retain(history: DataFrame, as_of, hours: float = RETENTION_HOURS) -> DataFrame:
    """Readings newer than ``as_of - hours`` and not after ``as_of``.

    ``as_of`` is a literal timestamp (a stream batch time), so the bounds are
    constants and reach the Parquet scan as pushed filters.
    """
    now = ntz_literal(as_of)
    return history.where((F.col("ts") > minus_seconds(now, round(hours * 3600))) & (F.col("ts") <= now))


def predict(
    requests: DataFrame,
    history: DataFrame,
    predictor=None,
    params: RunParams = RunParams(),
    rules: dict[str, CityRule] = CITY_RULES,
    with_lags: bool = True,
) -> DataFrame:
    """One response row per request; ``slot1..slot4`` kept when ``with_lags``."""
    # only what the response needs is kept
    validated = validate_requests(requests).select(*RESPONSE_INPUTS)
    looked_up = shared_lag_lookup(validated, history, params, rules)
    scored = forecast(looked_up, predictor or MeanOfLags(), rules)
    return shape_responses(scored, rules, extra=SLOT_COLS if with_lags else ())
