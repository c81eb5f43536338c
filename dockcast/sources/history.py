"""Raw history documents of the two bike feeds -> one history table.

Barcelona documents carry ``station_id`` / ``num_bikes_available``,
Santander documents ``dc:identifier`` / ``ayto:bicicletas_libres``; both hold
text values and an ISO-8601 UTC ``update_date``.  Values that do not parse
become null (the lookup then reports no history) instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockcast.functions import ISO_UTC, parse_int
from dockcast.schemas import BARCELONA_DOC, HISTORY, SANTANDER_DOC

# The field names of the two document layouts.
LAYOUTS = {
    "Barcelona": {"station": "station_id", "available": "num_bikes_available"},
    "Santander": {"station": "dc:identifier", "available": "ayto:bicicletas_libres"},
}


DOC_SCHEMAS = {"Barcelona": BARCELONA_DOC, "Santander": SANTANDER_DOC}


def read_history_docs(spark, path: str, city: str) -> DataFrame:
    """S3: a JSON-lines export of one feed's history documents, declared schema."""
    return spark.read.schema(DOC_SCHEMAS[city]).json(path)


def normalise_docs(docs: DataFrame, city: str, id_col: str = "_id") -> DataFrame:
    """One layout -> ``(city, station_id, ts, available, reading_id)``."""
    f = LAYOUTS[city]
    return docs.select(
        F.lit(city).alias("city"),
        parse_int(F.col(f"`{f['station']}`")).alias("station_id"),
        F.try_to_timestamp(F.col("update_date"), F.lit(ISO_UTC)).cast("timestamp_ntz").alias("ts"),
        parse_int(F.col(f"`{f['available']}`")).alias("available"),
        F.col(id_col).cast("long").alias("reading_id"),
    )


def normalise_history(barcelona_docs: DataFrame, santander_docs: DataFrame, id_col: str = "_id") -> DataFrame:
    """Both layouts into the normalised history (a narrow union, no shuffle)."""
    out = normalise_docs(barcelona_docs, "Barcelona", id_col).unionByName(
        normalise_docs(santander_docs, "Santander", id_col)
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY.fields])


def docs_from_history(history: DataFrame, city: str) -> DataFrame:
    """Write-side twin of S4: history rows of a city in that city's raw layout."""
    f = LAYOUTS[city]
    return history.where(F.col("city") == city).select(
        F.col("reading_id").alias("_id"),
        F.date_format("ts", ISO_UTC).alias("update_date"),
        F.col("station_id").cast("string").alias(f["station"]),
        F.col("available").cast("string").alias(f["available"]),
    )


def write_history(history: DataFrame, path: str, mode: str = "append", fanout: int = 16) -> None:
    """S3 store: Parquet partitioned by ``city`` and ``day`` (wall-clock UTC date).

    Readers that bound ``ts`` (retention, a stream batch) prune whole day
    folders, and the remaining ``ts`` bound is pushed into the file scan.
    A (city, day) folder is written by up to ``fanout`` tasks (salted by a
    hash of the reading id), so a hot city-day never lands on one task; rows
    are clustered by station and time inside each file so row-group
    statistics stay selective.
    """
    salt = F.pmod(F.xxhash64("reading_id"), F.lit(fanout))
    (
        history.withColumn("day", F.to_date("ts"))
        .repartition("city", "day", salt)
        .sortWithinPartitions("station_id", "ts")
        .write.mode(mode)
        .partitionBy("city", "day")
        .parquet(path)
    )


def read_history(spark, path: str, since=None, until=None) -> DataFrame:
    """Read the store; ``since``/``until`` (wall-clock UTC) prune day folders and push down ``ts``."""
    from dockcast.functions import ntz_literal

    df = spark.read.parquet(path)
    if since is not None:
        lo = ntz_literal(since)
        df = df.where((F.col("day") >= F.to_date(lo)) & (F.col("ts") > lo))
    if until is not None:
        hi = ntz_literal(until)
        df = df.where((F.col("day") <= F.to_date(hi)) & (F.col("ts") <= hi))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY.fields])
