"""NGSI-LD notifications as text (batch or stream) -> one row per entity.

The reference listens on a port; here notifications land as JSON lines in a
folder, read with the same parser by ``spark.read.text`` or
``spark.readStream.text``.  No port is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.functions import property_attr
from dockcast.schemas import NOTIFICATION


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of a landing folder of JSON-lines notifications."""
    return spark.read.text(path)


def read_notification_stream(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | str | None = None,
    archive_dir: str | None = None,
) -> DataFrame:
    """Streaming read of the same landing folder.

    A batch admits files up to a number or a size.  With ``archive_dir`` files that a
    committed batch has read are moved there, so the landing folder's listing stays
    short; the folder must lie outside the landing folder.  (Spark's file source takes
    no file that is a week older than the newest one it has seen.)
    """
    options = {"maxFilesPerTrigger": max_files_per_trigger, "maxBytesPerTrigger": max_bytes_per_trigger}
    if archive_dir:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive_dir}
    reader = spark.readStream.format("text")
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, str(value))
    return reader.load(path)


def once_each(raw: DataFrame, window: str = "10 minutes", text_col: str = "value") -> DataFrame:
    """A notification that the broker delivers again within ``window`` of its first
    arrival is dropped, in the same batch, a later one or after a restart.

    Notifications are told apart by their id; those without one (or broken ones) are
    never taken for each other.  The state holds the ids of the window alone.  Arrival
    counts, not a time in the text, so no notification is too late to be answered.
    """
    own = F.concat(F.lit("none:"), F.expr("uuid()"))
    key = F.coalesce(F.concat(F.lit("id:"), F.try_variant_get(F.try_parse_json(F.col(text_col)), "$.id", "string")), own)
    keyed = raw.withColumns({"__key": key, "__arrived": F.current_timestamp()}).withWatermark("__arrived", window)
    return keyed.dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__arrived")


def flatten_entities(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse each notification and emit one row per entity.

    Broken JSON or a notification without entities yields one row with a null entity,
    so nothing vanishes silently.
    """
    parsed = raw.select(
        F.col(text_col).alias("raw"),
        F.from_json(F.col(text_col), NOTIFICATION).alias("n"),
    )
    return parsed.select(
        "raw",
        F.col("n.id").alias("notification_id"),
        F.explode_outer("n.data").alias("entity"),
    )


def entities_to_notifications(requests: DataFrame, per_notification: int = 1) -> DataFrame:
    """Write-side twin of S2: typed requests -> notification JSON text.

    Used to land driver-table requests as notifications (tests, replay).
    ``requests`` needs the columns of ``sources.tables.requests_from_events``.
    """
    entity = F.struct(
        F.concat(F.lit("urn:ngsi-ld:ReqPrediction:"), F.col("request_id").cast("string")).alias("id"),
        F.lit("ReqPrediction").alias("type"),
        property_attr(F.col("id_station")).alias("idStation"),
        property_attr(F.col("weekday_raw")).alias("weekday"),
        property_attr(F.col("hour_raw")).alias("hour"),
        property_attr(F.col("month_raw")).alias("month"),
        property_attr(F.col("city")).alias("city"),
        property_attr(F.col("prediction_id")).alias("predictionId"),
        property_attr(F.col("socket_id")).alias("socketId"),
    )
    return requests.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("urn:ngsi-ld:Notification:"), F.col("request_id").cast("string")).alias("id"),
                F.lit("Notification").alias("type"),
                F.array(entity).alias("data"),
            )
        ).alias("value"),
        F.col("requested_at"),
    )
