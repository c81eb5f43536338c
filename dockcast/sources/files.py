"""CSV training tables, station dimension, model folders.

All CSV reads use a declared schema (no inference) with a header.  Spark's
CSV reader strips a UTF-8 BOM, accepts CRLF and quoted commas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dockcast.config import MALAGA_STATION_NAMES
from dockcast.schemas import STATIONS, STATIONS_PER_CITY, TRAIN_SCHEMAS

CORRUPT = "_corrupt_record"
BAD_ROW = "bad_row"
# The training files' names.
TRAINING_FILES = {"Barcelona": "barcelona_bike.csv", "Santander": "santander_bike.csv", "Malaga": "malaga_parking.csv"}


def read_training_csv(spark: SparkSession, path: str, city: str, quarantine: bool = True) -> DataFrame:
    """Declared schema, header, comma.

    PERMISSIVE mode (the default) turns a bad cell into null; with
    ``quarantine`` the raw text of such rows is kept in ``_corrupt_record``
    so they can be set aside instead of silently training on nulls.
    """
    schema = TRAIN_SCHEMAS[city]
    if not quarantine:
        reader = spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE")
        return reader.csv(path)
    # lines are parsed as a column, so the raw text is a column like any other
    names = ",".join(f.name for f in schema.fields)
    line = F.regexp_replace("value", "^\ufeff", "")
    lines = spark.read.text(path).select(line.alias("line")).where((F.col("line") != names) & (F.trim("line") != ""))
    full = StructType(schema.fields + [StructField(CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    row = F.from_csv("line", full.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return lines.select(row.alias("r")).select("r.*")


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows and quarantined rows of a ``read_training_csv`` result."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull())


def judged_training_csv(spark: SparkSession, path: str, city: str) -> DataFrame:
    """Rows of a training file with ``reason``: null where the row is sound, else
    ``bad_row``; a bad row's columns are null and its text is in ``raw``."""
    rows = read_training_csv(spark, path, city)
    bad = F.col(CORRUPT).isNotNull()
    columns = [F.when(~bad, F.col(c)).alias(c) for c in rows.columns if c != CORRUPT]
    return rows.select(*columns, F.col(CORRUPT).alias("raw"), F.when(bad, F.lit(BAD_ROW)).alias("reason"))


def read_stations(spark: SparkSession, path: str, per_city: bool = False) -> DataFrame:
    """Station dimension -> ``(city, station_id, name)``.

    The combined file has an ``id`` column and quoted names with commas; the
    per-city files drop ``id`` and carry a BOM and CRLF line ends.
    """
    schema = STATIONS_PER_CITY if per_city else STATIONS
    df = spark.read.schema(schema).option("header", "true").option("quote", '"').csv(path)
    return df.select(
        F.trim(F.col("City")).alias("city"),
        F.col("station_id"),
        F.trim(F.col("name")).alias("name"),
    )


def malaga_stations(spark: SparkSession) -> DataFrame:
    """J4 for Malaga: a car park's number is its position in the fixed name list."""
    return spark.createDataFrame(
        [("Malaga", i, n) for i, n in enumerate(MALAGA_STATION_NAMES)], "city string, station_id int, name string"
    )
