"""DuckDB twins of the registered queries (the driver's correctness oracle).

Written as plain SQL over the driver's views, generated from the same city
rules as the Spark operators.  Oracle traps handled here: DuckDB's
``dayofweek`` is 0-based, date parts are BIGINT (cast to INT), ``/`` on
doubles only, rounding written out as ``floor(x + 0.5)``.
"""

from __future__ import annotations

from dockcast.config import (
    CITY_RULES,
    EVENT_TYPE_CITY,
    HOUR_RANGE,
    MONTH_RANGE,
    OTHER_CITY,
    WEEKDAY_RANGE,
    CityRule,
)


def city_of_event(col: str = "event_type") -> str:
    arms = " ".join(f"WHEN '{et}' THEN '{c}'" for et, c in EVENT_TYPE_CITY.items())
    return f"(CASE {col} {arms} ELSE '{OTHER_CITY}' END)"


def _case_city(value_of, rules=CITY_RULES, col: str = "city") -> str:
    arms = " ".join(f"WHEN '{c}' THEN {value_of(r)}" for c, r in rules.items())
    return f"(CASE {col} {arms} END)"


def history_sql() -> str:
    return (
        f"SELECT {city_of_event()} AS city, CAST(user_id AS INTEGER) AS station_id, ts, "
        "CAST(floor(value) AS INTEGER) AS available, event_id AS reading_id FROM events"
    )


def requests_sql() -> str:
    return f"""
SELECT event_id AS request_id,
       's-' || CAST(event_id AS VARCHAR) AS socket_id,
       'p-' || CAST(event_id AS VARCHAR) AS prediction_id,
       {city_of_event()} AS city,
       CAST(user_id AS VARCHAR) AS id_station,
       CAST(user_id AS INTEGER) AS station_id,
       CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday,
       CAST(((TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 30) + 30) % 30 AS INTEGER) AS hour,
       CAST(month(ts) AS INTEGER) AS month,
       date_trunc('hour', ts) AS requested_at
FROM events"""


def validated_sql() -> str:
    smin = _case_city(lambda r: str(r.station_min))
    smax = _case_city(lambda r: str(r.station_max))
    cities = ", ".join(f"'{c}'" for c in CITY_RULES)
    return f"""
SELECT *,
  CASE WHEN city IS NULL OR city NOT IN ({cities}) THEN 'unknown_city'
       WHEN station_id IS NULL OR hour IS NULL OR weekday IS NULL OR month IS NULL
            OR socket_id IS NULL OR prediction_id IS NULL OR requested_at IS NULL THEN 'malformed'
       WHEN NOT (station_id BETWEEN {smin} AND {smax}
                 AND hour BETWEEN {HOUR_RANGE[0]} AND {HOUR_RANGE[1]}
                 AND weekday BETWEEN {WEEKDAY_RANGE[0]} AND {WEEKDAY_RANGE[1]}
                 AND month BETWEEN {MONTH_RANGE[0]} AND {MONTH_RANGE[1]}) THEN 'invalid_request'
       ELSE 'ok' END AS status0
FROM req"""


def lookups_sql(unit: int) -> str:
    """J1/J2 by brute force: range join + arg_min/arg_max per slot."""
    lrules = {c: r for c, r in CITY_RULES.items() if r.lookups}
    slot_exprs = []
    for slot in (1, 2, 3, 4):
        arms = []
        for c, r in lrules.items():
            lk = next((x for x in r.lookups if x.slot == slot), None)
            if lk is None:
                continue
            fn = "arg_min" if lk.kind == "earliest" else "arg_max"
            arms.append(
                f"WHEN '{c}' THEN {fn}({{'a': h.available}}, (h.ts, h.reading_id)) "
                f"FILTER (WHERE h.ts > v.requested_at - INTERVAL {lk.k * unit} SECOND).a"
            )
        slot_exprs.append(f"(CASE v.city {' '.join(arms)} END) AS slot{slot}")
    dmax = _case_city(lambda r: str(r.lookback * unit), lrules, col="v.city")
    cities = ", ".join(f"'{c}'" for c in lrules)
    return f"""
SELECT v.request_id, {', '.join(slot_exprs)}
FROM val v JOIN hist h
  ON h.city = v.city AND h.station_id = v.station_id
 AND h.ts <= v.requested_at
 AND h.ts > v.requested_at - to_seconds({dmax})
WHERE v.status0 = 'ok' AND v.city IN ({cities})
GROUP BY v.request_id, v.city"""


def looked_up_sql() -> str:
    lrules = [c for c, r in CITY_RULES.items() if r.lookups]
    nolk = [c for c, r in CITY_RULES.items() if not r.lookups]
    in_l = ", ".join(f"'{c}'" for c in lrules)
    in_n = ", ".join(f"'{c}'" for c in nolk) or "''"
    slot = lambda i: (
        f"CASE WHEN v.status0 = 'ok' AND v.city IN ({in_l}) THEN l.slot{i} "
        f"WHEN v.status0 = 'ok' AND v.city IN ({in_n}) THEN 0 END AS slot{i}"
    )
    return f"""
SELECT v.*, {', '.join(slot(i) for i in (1, 2, 3, 4))},
  CASE WHEN v.status0 = 'ok' AND v.city IN ({in_l})
            AND (l.slot1 IS NULL OR l.slot2 IS NULL OR l.slot3 IS NULL OR l.slot4 IS NULL)
       THEN 'no_history' ELSE v.status0 END AS status
FROM val v LEFT JOIN lk l USING (request_id)"""


def _steps_sql(rule: CityRule) -> str:
    if rule.step is None:
        return "1"
    # whole steps between the request and the next time the target hour comes
    gap = "date_diff('hour', date_trunc('day', requested_at) + to_hours(hour(requested_at)), date_trunc('day', requested_at) + to_hours(hour) + CASE WHEN hour(requested_at) > hour THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)"
    n = f"(1 + {gap} // {rule.step})"
    return f"(CASE WHEN {n} > {rule.max_steps} OR {n} <= 1 THEN 1 ELSE {n} END)"


def mean_of_lags_sql(rule: CityRule) -> str:
    slots = sorted(rule.slot_features)
    if not slots:
        return "CAST((station_id + weekday + hour) % 11 AS DOUBLE)"
    total = " + ".join(f"CAST(s{s} AS DOUBLE)" for s in slots)
    return f"(({total}) / {float(len(slots))})"


def round_half_up_float_sql(x: str) -> str:
    return f"CAST(floor(CAST(CAST({x} AS FLOAT) AS DOUBLE) + 0.5) AS INTEGER)"


def forecast_sql(source: str = "lu", step=None) -> tuple[str, str]:
    """F1 unrolled: CTE text and the name of the last step's relation; ``step`` gives
    a city's prediction over the row (``z``) and its lag state, else the mean of lags."""
    step = step or mean_of_lags_sql
    max_steps = max(r.unrolled_steps for r in CITY_RULES.values())
    ctes = [
        f"""f0 AS (SELECT *, CASE WHEN status = 'ok' THEN {_case_city(_steps_sql)} END AS steps,
              slot1 AS s1, slot2 AS s2, slot3 AS s3, slot4 AS s4,
              CAST(NULL AS DOUBLE) AS prediction FROM {source})"""
    ]
    for i in range(1, max_steps + 1):
        live = {c: r for c, r in CITY_RULES.items() if r.unrolled_steps >= i}
        p = _case_city(step, live)
        r = round_half_up_float_sql(p)
        ctes.append(
            f"""f{i} AS (SELECT * REPLACE (
              CASE WHEN steps >= {i} THEN {p} ELSE prediction END AS prediction,
              CASE WHEN steps > {i} THEN {r} ELSE s1 END AS s1,
              CASE WHEN steps > {i} THEN s1 ELSE s2 END AS s2,
              CASE WHEN steps > {i} THEN s2 ELSE s3 END AS s3,
              CASE WHEN steps > {i} THEN s3 ELSE s4 END AS s4) FROM f{i - 1} z)"""
        )
    return ",\n".join(ctes), f"f{max_steps}"


def prediction_value_sql() -> str:
    scaled = _case_city(lambda r: f"{round_half_up_float_sql('prediction')} * {r.output_scale}")
    return f"CAST(CASE WHEN status = 'ok' AND prediction IS NOT NULL THEN {scaled} ELSE -1 END AS INTEGER)"


def payload_sql() -> str:
    prop = lambda c: f"json_object('value', {c}, 'type', 'Property')"
    fields = ["socketId", "predictionId", "predictionValue", "idStation", "weekday", "hour", "month", "city"]
    return "CAST(json_object(" + ", ".join(f"'{f}', {prop(f)}" for f in fields) + ") AS VARCHAR)"


def prediction_pipeline_sql(unit: int, with_lags: bool = True, history: str | None = None, more: list[str] = (), step=None) -> str:
    fc_ctes, last = forecast_sql(step=step)
    fc_ctes = ",\n".join([*more, fc_ctes])
    lags = ", slot1, slot2, slot3, slot4" if with_lags else ""
    return f"""
WITH req AS ({requests_sql()}),
hist AS ({history or history_sql()}),
val AS ({validated_sql()}),
lk AS ({lookups_sql(unit)}),
lu AS ({looked_up_sql()}),
{fc_ctes},
shaped AS (
  SELECT request_id, socket_id AS socketId, prediction_id AS predictionId,
         {prediction_value_sql()} AS predictionValue,
         COALESCE(CAST(station_id AS VARCHAR), id_station) AS idStation,
         weekday, hour, month, city, status, CAST(CASE WHEN status = 'ok' THEN steps END AS INTEGER) AS steps{lags}
  FROM {last})
SELECT *, {payload_sql()} AS payload FROM shaped"""
