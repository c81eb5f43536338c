"""Declared schemas (no inference anywhere)."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# One NGSI-LD attribute: the value is kept as its JSON text so that a number
# (20) and a string ("20") parse the same way.
ATTR = StructType([StructField("type", StringType()), StructField("value", StringType())])

REQUEST_ATTRS = ("idStation", "weekday", "hour", "month", "city", "predictionId", "socketId")

ENTITY = StructType(
    [StructField("id", StringType()), StructField("type", StringType())]
    + [StructField(a, ATTR) for a in REQUEST_ATTRS]
)

NOTIFICATION = StructType(
    [
        StructField("id", StringType()),
        StructField("type", StringType()),
        StructField("data", ArrayType(ENTITY)),
    ]
)

# Normalised station history (all cities, one layout).
HISTORY = StructType(
    [
        StructField("city", StringType()),
        StructField("station_id", IntegerType()),
        StructField("ts", TimestampNTZType()),
        StructField("available", IntegerType()),
        StructField("reading_id", LongType()),
    ]
)

# Raw history documents of the two bike feeds (``_id`` as exported).
BARCELONA_DOC = StructType(
    [
        StructField("_id", LongType()),
        StructField("update_date", StringType()),
        StructField("station_id", StringType()),
        StructField("num_bikes_available", StringType()),
    ]
)
SANTANDER_DOC = StructType(
    [
        StructField("_id", LongType()),
        StructField("update_date", StringType()),
        StructField("dc:identifier", StringType()),
        StructField("ayto:bicicletas_libres", StringType()),
    ]
)

# Training tables (CSV, header, comma).
TRAIN_BARCELONA = StructType(
    [StructField(c, IntegerType()) for c in (
        "available_bikes", "id_station", "hour", "three_before", "six_before", "nine_before", "day", "blank", "comp"
    )]
)
TRAIN_SANTANDER = StructType(
    [
        StructField("available_bikes", IntegerType()),
        StructField("modified", StringType()),
        StructField("id_station", IntegerType()),
        StructField("five_before", IntegerType()),
        StructField("ten_before", IntegerType()),
        StructField("fifteen_before", IntegerType()),
        StructField("twenty_before", IntegerType()),
    ]
)
TRAIN_MALAGA = StructType(
    [
        StructField("name", IntegerType()),
        StructField("availableSpotNumber", IntegerType()),
        StructField("timestamp", StringType()),
        StructField("weekday", IntegerType()),
        StructField("total", IntegerType()),
        StructField("day", IntegerType()),
        StructField("month", IntegerType()),
        StructField("hour", IntegerType()),
        StructField("minute", IntegerType()),
        StructField("hour_interval", IntegerType()),
        StructField("time", StringType()),
        StructField("available", DoubleType()),
        StructField("occupation", IntegerType()),
    ]
)
TRAIN_SCHEMAS = {"Barcelona": TRAIN_BARCELONA, "Santander": TRAIN_SANTANDER, "Malaga": TRAIN_MALAGA}

STATIONS = StructType(
    [
        StructField("id", IntegerType()),
        StructField("station_id", IntegerType()),
        StructField("name", StringType()),
        StructField("City", StringType()),
    ]
)
STATIONS_PER_CITY = StructType(
    [StructField("station_id", IntegerType()), StructField("name", StringType()), StructField("City", StringType())]
)

# Shaped response (the 8 reference fields) plus our status.
RESPONSE_FIELDS = ("socketId", "predictionId", "predictionValue", "idStation", "weekday", "hour", "month", "city")
