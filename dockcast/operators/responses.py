"""Response shaping and last-write-wins snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockcast.config import CITY_RULES, OK, UNAVAILABLE, CityRule
from dockcast.functions import property_attr, round_half_up_float
from dockcast.schemas import RESPONSE_FIELDS


def prediction_value(rules: dict[str, CityRule] = CITY_RULES):
    """Rounded prediction scaled per city, -1 unless status ok."""
    scaled = None
    for city, rule in rules.items():
        v = round_half_up_float(F.col("prediction")) * F.lit(rule.output_scale)
        cond = F.col("city") == city
        scaled = F.when(cond, v) if scaled is None else scaled.when(cond, v)
    return F.when((F.col("status") == OK) & F.col("prediction").isNotNull(), scaled).otherwise(
        F.lit(UNAVAILABLE)
    ).cast("int")


def shape_responses(
    scored: DataFrame, rules: dict[str, CityRule] = CITY_RULES, extra: tuple[str, ...] = ()
) -> DataFrame:
    """The eight response fields, ``status`` and the JSON payload.

    ``idStation`` is the parsed station number as text (the reference casts
    to int before answering), or the raw text when it did not parse.
    """
    out = scored.select(
        "request_id",
        F.col("socket_id").alias("socketId"),
        F.col("prediction_id").alias("predictionId"),
        prediction_value(rules).alias("predictionValue"),
        F.coalesce(F.col("station_id").cast("string"), F.col("id_station")).alias("idStation"),
        F.col("weekday"),
        F.col("hour"),
        F.col("month"),
        F.col("city"),
        F.col("status"),
        F.col("steps"),
        *extra,
    )
    payload = F.to_json(F.struct(*_payload_fields()), {"ignoreNullFields": "false"})
    return out.withColumn("payload", payload)


def _payload_fields():
    """Every response field as an NGSI-LD property, in the reference's key order."""
    return [property_attr(F.col(f)).alias(f) for f in RESPONSE_FIELDS]


def latest_per_key(df: DataFrame, key: list[str] | str, order: list[str] | str) -> DataFrame:
    """Last write wins - the newest row per key, ``order`` breaking ties.

    A plain ``max_by`` aggregate: partial aggregation before the shuffle, so a
    key written millions of times (the single response entity of the
    reference) costs one row per task, not one group in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order] if isinstance(order, str) else list(order)
    others = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])
