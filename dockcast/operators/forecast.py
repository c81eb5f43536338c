"""Recursive multi-step forecast for all requests at once.

The reference predicts, collects the first prediction to the driver, builds a
shifted request and starts a new job, once per step and for one request.
Here the recursion is unrolled into a fixed number of projections over the
whole batch: every row carries its own step count ``n`` (C10 + F3 guard) and
its lag state; step ``i`` scores all rows, and rows with ``i < n`` shift the
rounded prediction into lag 1 (F2).  No collect, no driver round trip, one
lazy plan whose size is bounded by the largest valid ``n`` (8 steps).
O3/Q1/Q2: nothing is taken with ``head()``/``first()`` - every row of a
batch is routed by its own city and scored with its own ``n``.

Predictors plug in through ``score(df, rule, out_col)``:

* :class:`MeanOfLags` - a SQL-expressible baseline (mean of the city's lag
  features), used to check the recursion against DuckDB;
* :class:`~dockcast.operators.trees.TreePredictor` - the saved trees and forests as
  expressions;
* :class:`ModelPredictor` - any fitted MLlib ``PipelineModel`` per city.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockcast.config import CITY_RULES, OK, CityRule
from dockcast.functions import horizon_guard, steps_to_target
from dockcast.operators.lookup import settled

STATE = ("s1", "s2", "s3", "s4")


def lag_features(rule: CityRule) -> list[str]:
    return [rule.slot_features[s] for s in sorted(rule.slot_features)]


class MeanOfLags:
    """Mean of the city's lag features; for a city without lags a class 0..10 from
    the calendar features, ``(station + weekday + hour) mod 11``.

    An *expression* predictor: ``sql`` maps the lag state (``s1..s4``)
    straight to a SQL expression, so each recursion step is one projection.
    """

    def sql(self, rule: CityRule) -> str:
        slots = sorted(rule.slot_features)
        if not slots:
            return "CAST(pmod(station_id + _req_weekday + _req_hour, 11) AS DOUBLE)"
        total = " + ".join(f"CAST(s{slot} AS DOUBLE)" for slot in slots)
        return f"(({total}) / {float(len(slots))})"


class ModelPredictor:
    """Score with one fitted ``PipelineModel`` per city (M7)."""

    def __init__(self, models: dict):
        self.models = models

    def score(self, df: DataFrame, rule: CityRule, out_col: str) -> DataFrame:
        model = self.models.get(rule.city)
        if model is None:
            return df.withColumn(out_col, F.lit(None).cast("double"))
        before = set(df.columns)
        out = model.transform(df).withColumnRenamed("prediction", out_col)
        extra = [c for c in out.columns if c not in before and c != out_col]
        return out.drop(*extra)


def _case_city(rules: dict[str, CityRule], value_of, default: Column | None = None) -> Column:
    expr = None
    for city, rule in rules.items():
        cond = F.col("city") == city
        v = value_of(rule)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr if default is None else expr.otherwise(default)


def steps_column(rules: dict[str, CityRule] = CITY_RULES) -> Column:
    """C10 + F3 per row: model applications for the row's city and hours."""
    now_hour = F.hour("requested_at")

    def n_of(rule: CityRule) -> Column:
        if rule.step is None:
            return F.lit(1)
        return horizon_guard(steps_to_target(F.col("hour"), now_hour, rule.step), rule.max_steps)

    return _case_city(rules, n_of)


# request columns whose names the models use as feature names
_CLASHING = ("id_station", "hour", "weekday", "month")


def _feature_columns(rules: dict[str, CityRule]) -> list[Column]:
    """Model inputs from the lag state, null-safe so any row can be scored."""
    cols = {
        "id_station": F.coalesce(F.col("station_id"), F.lit(0)),
        "name": F.coalesce(F.col("station_id"), F.lit(0)),
        "hour": F.coalesce(F.col("_req_hour"), F.lit(0)),
        "weekday": F.coalesce(F.col("_req_weekday"), F.lit(0)),
    }
    for rule in rules.values():
        for slot, fname in rule.slot_features.items():
            cols[fname] = F.coalesce(F.col(f"s{slot}"), F.lit(0))
    return [v.alias(k) for k, v in cols.items()]


def _q(name: str) -> str:
    return f"`{name}`"


def forecast(df: DataFrame, predictor, rules: dict[str, CityRule] = CITY_RULES) -> DataFrame:
    """add ``steps`` and ``prediction`` (double, null unless status ok).

    ``df`` needs ``city, station_id, id_station, hour, weekday, month,
    requested_at, status, slot1..slot4``.  Q7 (the target hour is fed to
    every step) and Q8 (intermediate predictions are rounded) are kept.
    Every step is one projection for an expression predictor; models are
    applied to the rows of their own city only, one feature projection and one
    ``transform`` a step, and rows of unknown cities pass by.  ``df`` is written first
    then, so that what made it runs once for all cities.  A row that is ok but whose
    city has no model has no prediction.
    """
    if hasattr(predictor, "sql"):
        return _unrolled(df, predictor, rules)
    df = settled(df)
    parts = [_unrolled(df.where(F.col("city") == c), predictor, {c: r}) for c, r in rules.items()]
    unknown = ~F.coalesce(F.col("city").isin(*rules), F.lit(False))
    parts.append(
        df.where(unknown).select(
            "*", F.lit(None).cast("int").alias("steps"), F.lit(None).cast("double").alias("prediction")
        )
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unrolled(df: DataFrame, predictor, rules: dict[str, CityRule]) -> DataFrame:
    """The recursion over rows of ``rules``' cities.  Projections are written as SQL
    text: one JVM call each, so building the plan stays cheap however many steps."""
    original = df.columns
    max_steps = max(r.unrolled_steps for r in rules.values())
    carried = [c if c not in _CLASHING else f"_req_{c}" for c in original]
    renames = [f"{_q(c)} AS {_q(n)}" for c, n in zip(original, carried)]
    cur = df.select(
        *[F.expr(r) for r in renames],
        F.when(F.col("status") == OK, steps_column(rules)).alias("steps"),
        *[F.col(f"slot{i + 1}").alias(s) for i, s in enumerate(STATE)],
        F.lit(None).cast("double").alias("fc_prediction"),
    )
    base = [*map(_q, carried), "steps", "fc_prediction", *STATE]
    for i in range(1, max_steps + 1):
        live = {c: r for c, r in rules.items() if r.unrolled_steps >= i}
        if hasattr(predictor, "sql"):
            # rows that are done, or never had a step, aren't scored again
            p_step = f"(CASE WHEN steps >= {i} THEN {_case_city_sql(live, predictor.sql)} END)"
        else:
            cur = cur.select(*[F.expr(c) for c in base], *_feature_columns(rules))
            for city, rule in live.items():
                cur = predictor.score(cur, rule, f"pred_{city}")
            p_step = _case_city_sql(live, lambda r: f"pred_{r.city}")
        # the prediction is a column of its own, as the update reads it twice
        cur = cur.selectExpr(*map(_q, carried), "steps", "fc_prediction", *STATE, f"{p_step} AS p_step")
        cur = cur.selectExpr(*map(_q, carried), "steps", *_step_update("p_step", i, max_steps))
    return cur.selectExpr(
        *[f"{_q(n)} AS {_q(c)}" for c, n in zip(original, carried)],
        "steps",
        f"CASE WHEN status = '{OK}' THEN fc_prediction END AS prediction",
    )


def forecast_steps(df: DataFrame, predictor, rules: dict[str, CityRule]) -> DataFrame:
    """F1 with every step's prediction: one row for each row of ``df`` and step (from 1
    to the most that a valid request of its city can need).  ``predictor`` is an
    expression predictor; ``df`` is as for ``forecast``, with status ok."""
    carried = [c if c not in _CLASHING else f"_req_{c}" for c in df.columns]
    cur = df.select(
        *[F.col(c).alias(n) for c, n in zip(df.columns, carried)], *[F.col(f"slot{i + 1}").alias(s) for i, s in enumerate(STATE)]
    )
    most = max(r.unrolled_steps for r in rules.values())
    made: list[str] = []
    for i in range(1, most + 1):
        live = {c: r for c, r in rules.items() if r.unrolled_steps >= i}
        p_step = _case_city_sql(live, predictor.sql)
        cur = cur.selectExpr(*map(_q, carried), *STATE, *made, f"{p_step} AS p{i}")
        made.append(f"p{i}")
        rounded = _rounded_sql(f"p{i}")
        cur = cur.selectExpr(*map(_q, carried), f"{rounded} AS s1", "s1 AS s2", "s2 AS s3", "s3 AS s4", *made)
    steps = ", ".join(f"named_struct('step', {i + 1}, 'prediction', {p})" for i, p in enumerate(made))
    out = cur.selectExpr(*[f"{_q(n)} AS {_q(c)}" for c, n in zip(df.columns, carried)], f"explode(array({steps})) AS p")
    return out.select(*df.columns, "p.step", "p.prediction").where("prediction IS NOT NULL")


def _rounded_sql(p: str) -> str:
    """C3."""
    return f"CAST(floor(CAST(CAST({p} AS FLOAT) AS DOUBLE) + 0.5) AS INT)"


def _case_city_sql(rules: dict[str, CityRule], sql_of) -> str:
    arms = " ".join(f"WHEN '{city}' THEN {sql_of(rule)}" for city, rule in rules.items())
    return f"(CASE city {arms} END)"


def _step_update(p_step: str, i: int, max_steps: int) -> list[str]:
    """keep the prediction of the row's last step; shift the rounded one into lag 1."""
    out = [f"CASE WHEN steps >= {i} THEN {p_step} ELSE fc_prediction END AS fc_prediction"]
    if i == max_steps:
        return out + list(STATE)
    prev = {"s1": _rounded_sql(p_step), "s2": "s1", "s3": "s2", "s4": "s3"}
    return out + [f"CASE WHEN steps > {i} THEN {prev[s]} ELSE {s} END AS {s}" for s in STATE]
