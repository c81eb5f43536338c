"""Driver parquet tables and the history / request views built over them.

The driver's ``events`` table stands in for the live feeds:

* history reading  = (city of the event type, station ``user_id``, ``ts``,
  ``floor(value)`` bikes available, ``event_id``);
* prediction request = the same event seen as a request issued at the start
  of its hour, asking for the hour ``props.k mod 30`` (values above 23 are
  invalid on purpose).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.config import EVENT_TYPE_CITY, OTHER_CITY

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_city(event_type: str = "event_type") -> Column:
    """Map an event type onto a city; anything else is ``Other``.

    One flat ``CASE`` so that a filter on the city folds into a predicate on
    ``event_type`` that the Parquet scan can evaluate.
    """
    arms = " ".join(f"WHEN '{et}' THEN '{city}'" for et, city in EVENT_TYPE_CITY.items())
    return F.expr(f"CASE `{event_type}` {arms} ELSE '{OTHER_CITY}' END")


def history_from_events(events: DataFrame) -> DataFrame:
    """Normalised history ``(city, station_id, ts, available, reading_id)``."""
    return events.select(
        event_city("event_type").alias("city"),
        F.col("user_id").cast("int").alias("station_id"),
        F.col("ts"),
        F.floor("value").cast("int").alias("available"),
        F.col("event_id").alias("reading_id"),
    )


def requests_from_events(events: DataFrame) -> DataFrame:
    """Typed prediction requests, as P1 would produce them from notifications.

    Attribute values stay text here (as they arrive in JSON); the request
    operators parse and validate them.
    """
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("s-"), F.col("event_id").cast("string")).alias("socket_id"),
        F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("prediction_id"),
        event_city("event_type").alias("city"),
        F.col("user_id").cast("string").alias("id_station"),
        F.dayofweek("ts").cast("string").alias("weekday_raw"),
        F.pmod(k, F.lit(30)).cast("string").alias("hour_raw"),
        F.month("ts").cast("string").alias("month_raw"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("requested_at"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` scan, listed anew at each call, so new files are read."""
    return read_table(spark, sf_dir, "events")


def events_history(spark: SparkSession, sf_dir: str, cities: list[str] | None = None) -> DataFrame:
    """History over ``events``; ``cities`` restricts it with a predicate on the
    raw ``event_type`` column, which reaches the Parquet scan (the derived
    ``city`` cannot be pushed through the mapping)."""
    ev = events(spark, sf_dir)
    if cities is not None:
        types = [et for et, c in EVENT_TYPE_CITY.items() if c in cities]
        ev = ev.where(F.col("event_type").isin(types))
    return history_from_events(ev)


def events_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from_events(events(spark, sf_dir))
