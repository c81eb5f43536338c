"""Training tables and station profiles built from the history.

The reference trains from CSV files whose producer is not in its tree; the
column names say what they hold (a reading and the readings k hours before
it, calendar parts, an occupancy decile).  These operators build the same
tables from the normalised history and the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockcast.config import DAY, HOUR, CityRule
from dockcast.functions import iso_utc, occupancy_decile

_TRUNC = {HOUR: "hour", DAY: "day"}


def _trunc_unit(unit: int) -> str:
    if unit not in _TRUNC:
        raise ValueError(f"lag unit must be one of {sorted(_TRUNC)} seconds, got {unit}")
    return _TRUNC[unit]


def resample(history: DataFrame, unit: int = HOUR) -> DataFrame:
    """Last reading per ``(city, station_id, slot)`` on a grid of ``unit`` seconds."""
    slot = F.date_trunc(_trunc_unit(unit), "ts").cast("timestamp_ntz")
    return (
        history.withColumn("slot_ts", slot)
        .groupBy("city", "station_id", "slot_ts")
        .agg(F.max_by("available", F.struct("ts", "reading_id")).alias("available"))
    )


def lag_training_table(history: DataFrame, rule: CityRule, unit: int = HOUR) -> DataFrame:
    """One row per resampled reading with the readings ``k`` units earlier.

    Each resampled row is copied forward to every target slot that uses it
    as a lag, then one aggregate per ``(city, station, target slot)`` gathers
    label and lags: two shuffles, both on keys that include the time slot,
    so a hot station is spread over many tasks; no self-join.
    Lags may be null where the history has gaps.
    """
    lags = dict(rule.train_lags)
    grid = resample(history.where(F.col("city") == rule.city), unit)
    shifts = [("label", 0)] + list(lags.items())
    shifted = grid.select(
        "city",
        "station_id",
        "available",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("role"), F.timestamp_add("SECOND", F.lit(k * unit), "slot_ts").alias("target"))
                    for name, k in shifts
                ]
            )
        ).alias("s"),
    )
    table = shifted.groupBy("city", "station_id", F.col("s.target").alias("slot_ts")).agg(
        *[F.max(F.when(F.col("s.role") == name, F.col("available"))).alias(name) for name, _ in shifts]
    )
    table = table.where(F.col("label").isNotNull())
    if rule.city == "Barcelona":
        return table.select(
            F.col("label").alias("available_bikes"),
            F.col("station_id").alias("id_station"),
            F.hour("slot_ts").alias("hour"),
            *[F.col(n) for n in lags],
            F.dayofweek("slot_ts").alias("day"),
            F.lit(None).cast("int").alias("blank"),
            F.lit(None).cast("int").alias("comp"),
            F.col("slot_ts"),
        )
    return table.select(
        F.col("label").alias("available_bikes"),
        iso_utc("slot_ts").alias("modified"),
        F.col("station_id").alias("id_station"),
        *[F.col(n) for n in lags],
        F.col("slot_ts"),
    )


def with_trend(table: DataFrame, profile: DataFrame) -> DataFrame:
    """Fill the Barcelona ``comp`` column with the D4 trend of (station, hour).

    The profile has at most 24 rows per station: AQE broadcasts it where it
    measures small, and splits a hot station's side of the join where not.
    """
    p = profile.where(F.col("city") == "Barcelona").select(
        F.col("station_id").alias("id_station"), "hour", F.col("trend").alias("_trend")
    )
    joined = table.join(p, ["id_station", "hour"], "left")
    return joined.withColumn("comp", F.col("_trend")).drop("_trend")


def station_profile(history: DataFrame) -> DataFrame:
    """Mean availability per (city, station, hour of day) and its trend.

    ``trend`` is the sign of the change to the next hour (-1, 0, 1); 0 for
    hour 23 and where the next hour has no readings.  The window runs over
    at most 24 pre-aggregated rows per station.
    """
    prof = history.groupBy("city", "station_id", F.hour("ts").alias("hour")).agg(
        F.avg("available").alias("avg_available"), F.count(F.lit(1)).alias("readings")
    )
    return _with_change(prof)


PROFILE_KEY = ["city", "station_id", "hour"]
PROFILE_SUMS = ["total", "known", "readings"]


def profile_partials(readings: DataFrame, sign: int = 1) -> DataFrame:
    """Sums that profiles are made of, to be added up by ``PROFILE_KEY``; those of
    readings that are taken out have the sign -1."""
    one, known = F.lit(sign).cast("long"), F.col("available").isNotNull()
    return readings.select(
        "city", "station_id", F.hour("ts").alias("hour"),
        (F.coalesce(F.col("available"), F.lit(0)).cast("long") * one).alias("total"),
        F.when(known, one).otherwise(F.lit(0).cast("long")).alias("known"),
        one.alias("readings"),
    )


def profile_of_sums(sums: DataFrame) -> DataFrame:
    """``station_profile`` from added-up partials; groups without readings have no row."""
    mean = F.when(F.col("known") > 0, F.col("total") / F.col("known"))
    return _with_change(sums.where("readings > 0").select(*PROFILE_KEY, mean.alias("avg_available"), "readings"))


def _with_change(prof: DataFrame) -> DataFrame:
    w = Window.partitionBy("city", "station_id").orderBy("hour")
    nxt_hour = F.lead("hour").over(w)
    nxt_avg = F.lead("avg_available").over(w)
    trend = F.when(nxt_hour == F.col("hour") + 1, F.signum(nxt_avg - F.col("avg_available"))).otherwise(F.lit(0.0))
    return prof.withColumn("trend", trend.cast("int"))


def malaga_training_table(lineitem: DataFrame, capacity: int = 50) -> DataFrame:
    """D2 + C9 over the driver's ``lineitem``: a car park per supplier mod 10.

    free spots = capacity - quantity, ``available`` = free share,
    ``occupation`` = round((1 - available) * 10).  ``hour_interval`` is the
    half-hour index of the day (0..47).  ``l_shipdate`` is always midnight, so the
    minute of the day comes from the line's key.
    """
    minute = F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11, F.lit(1440)).cast("int")
    ts = F.timestamp_add("MINUTE", minute, F.col("l_shipdate"))
    free = F.floor(F.lit(capacity) - F.col("l_quantity")).cast("int")
    return lineitem.select(
        F.pmod(F.col("l_suppkey"), F.lit(10)).cast("int").alias("name"),
        free.alias("availableSpotNumber"),
        iso_utc(ts).alias("timestamp"),
        F.dayofweek(ts).alias("weekday"),
        F.lit(capacity).alias("total"),
        F.dayofmonth(ts).alias("day"),
        F.month(ts).alias("month"),
        F.hour(ts).alias("hour"),
        F.minute(ts).alias("minute"),
        (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int").alias("hour_interval"),
        F.date_format(ts, "HH:mm").alias("time"),
        (free.cast("double") / F.lit(float(capacity))).alias("available"),
    ).withColumn("occupation", occupancy_decile("available"))


__all__ = [
    "lag_training_table",
    "malaga_training_table",
    "resample",
    "station_profile",
    "with_trend",
]
