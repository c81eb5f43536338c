"""Request extraction, parsing, validation and routing.

Every request keeps its row; what the reference did with a shared mutable
flag becomes a per-row ``status`` column (Q5, Q6), and routing is by the
row's own city rather than by the first row of the batch (Q1, P4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockcast.config import (
    CITY_RULES,
    HOUR_RANGE,
    INVALID,
    MALFORMED,
    MONTH_RANGE,
    OK,
    UNKNOWN_CITY,
    WEEKDAY_RANGE,
)
from dockcast.functions import parse_int


def extract_requests(entities: DataFrame, requested_at: Column | None = None) -> DataFrame:
    """Pull the seven request attributes out of flattened entities.

    ``requested_at`` is the "now" of the request (the batch time in a
    stream); it defaults to the current timestamp as wall-clock UTC.
    The entity id repeats (clients PATCH one entity), so every flattened
    entity gets its own ``request_id``; identical notifications stay two
    requests.
    """
    now = requested_at if requested_at is not None else F.localtimestamp()
    e = F.col("entity")
    return entities.select(
        F.monotonically_increasing_id().alias("request_id"),
        F.coalesce(e["id"], F.col("notification_id")).alias("entity_id"),
        e["socketId"]["value"].alias("socket_id"),
        e["predictionId"]["value"].alias("prediction_id"),
        e["city"]["value"].alias("city"),
        e["idStation"]["value"].alias("id_station"),
        e["weekday"]["value"].alias("weekday_raw"),
        e["hour"]["value"].alias("hour_raw"),
        e["month"]["value"].alias("month_raw"),
        now.cast("timestamp_ntz").alias("requested_at"),
        F.col("raw"),
        e.isNull().alias("no_entity"),
    )


def _city_case(value_of) -> Column:
    expr = None
    for city, rule in CITY_RULES.items():
        cond = F.col("city") == city
        expr = F.when(cond, value_of(rule)) if expr is None else expr.when(cond, value_of(rule))
    return expr


def validate_requests(requests: DataFrame) -> DataFrame:
    """Typed columns plus ``status``.

    status precedence: unknown_city > malformed (missing or non-integer
    attribute, Q11) > invalid_request (out of the city's ranges, P2) > ok.
    """
    station = parse_int("id_station")
    hour = parse_int("hour_raw")
    weekday = parse_int("weekday_raw")
    month = parse_int("month_raw")
    typed = requests.withColumns(
        {"station_id": station, "hour": hour, "weekday": weekday, "month": month}
    )
    known = F.col("city").isin(list(CITY_RULES))
    malformed = (
        F.col("station_id").isNull()
        | F.col("hour").isNull()
        | F.col("weekday").isNull()
        | F.col("month").isNull()
        | F.col("socket_id").isNull()
        | F.col("prediction_id").isNull()
        | F.col("requested_at").isNull()
    )
    in_range = (
        F.col("station_id").between(_city_case(lambda r: F.lit(r.station_min)), _city_case(lambda r: F.lit(r.station_max)))
        & F.col("hour").between(*HOUR_RANGE)
        & F.col("weekday").between(*WEEKDAY_RANGE)
        & F.col("month").between(*MONTH_RANGE)
    )
    status = (
        F.when(~known | F.col("city").isNull(), F.lit(UNKNOWN_CITY))
        .when(malformed, F.lit(MALFORMED))
        .when(~in_range, F.lit(INVALID))
        .otherwise(F.lit(OK))
    )
    return typed.withColumn("status", status)


def route(requests: DataFrame, city: str) -> DataFrame:
    """The rows one city's model will score (its own, still ok)."""
    return requests.where((F.col("city") == city) & (F.col("status") == OK))


# why a notification's text can't be answered, besides the statuses
BROKEN = "broken_json"
NO_ENTITIES = "no_entities"
REJECT_REASONS = (BROKEN, NO_ENTITIES, UNKNOWN_CITY, MALFORMED, INVALID)


def with_reason(validated: DataFrame) -> DataFrame:
    """``reason`` (null for a request that can be answered) and ``detail``, the
    attributes at fault, of extracted and validated requests."""
    typed = {"station_id": "idStation", "hour": "hour", "weekday": "weekday", "month": "month"}
    missing = [F.when(F.col(c).isNull(), F.lit(a)) for c, a in {**typed, "socket_id": "socketId", "prediction_id": "predictionId"}.items()]
    ranges = {
        "station_id": (_city_case(lambda r: F.lit(r.station_min)), _city_case(lambda r: F.lit(r.station_max))),
        "hour": HOUR_RANGE, "weekday": WEEKDAY_RANGE, "month": MONTH_RANGE,
    }
    outside = [F.when(~F.col(c).between(*ranges[c]), F.lit(a)) for c, a in typed.items()]
    reason = (
        F.when(F.col("no_entity") & F.try_parse_json("raw").isNull(), F.lit(BROKEN))
        .when(F.col("no_entity"), F.lit(NO_ENTITIES))
        .when(F.col("status") != OK, F.col("status"))
    )
    detail = F.when(F.col("reason") == MALFORMED, F.concat_ws(",", *missing)).when(F.col("reason") == INVALID, F.concat_ws(",", *outside))
    return validated.withColumn("reason", reason).withColumn("detail", detail)


def write_letters(judged: DataFrame, path: str, reason: str = "reason", reasons: tuple[str, ...] = REJECT_REASONS) -> dict[str, int]:
    """Good and bad rows to ``path``/letter=good and ``path``/letter=bad in one pass; how
    many rows were good, and how many bad ones had each reason, counted on the way."""
    from pyspark.sql import Observation

    counted = Observation()
    counts = [F.count_if(F.col(reason).isNull()).alias("good"), *[F.count_if(F.col(reason) == r).alias(r) for r in reasons]]
    letter = F.when(F.col(reason).isNull(), "good").otherwise("bad")
    judged.observe(counted, *counts).withColumn("letter", letter).write.partitionBy("letter").parquet(path)
    return counted.get
