"""Registered queries of the service's parts: sources, commits, logs, dead letters,
training files, previews, maintained profiles and backtests, with DuckDB twins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.config import CADENCE_MINUTES, CITY_RULES, DAY, OK, RETENTION_HOURS
from dockcast.functions import iso_utc
from dockcast.operators import features as feat
from dockcast.operators.backtest import backtest, horizon_metrics
from dockcast.operators.lookup import settled, unknown_stations
from dockcast.operators.requests import extract_requests, validate_requests, with_reason, write_letters
from dockcast.plans import oracle
from dockcast.plans.predict import predict
from dockcast.plans.queries import FLAGSHIP_PARAMS, LAG_TREE_RULES, LEVEL, LOOKUP_CITIES, stations_from_supplier, training_table_santander
from dockcast.plans.queries import ORACLE_SQL as OTHER_SQL
from dockcast.plans.queries import _grid_sql, _lag_groups_sql, _lag_table_sql, _levels, _scratch, _stations_sql
from dockcast.plans.training import preview, train_city
from dockcast.sources.files import BAD_ROW, judged_training_csv
from dockcast.sources.history_store import HistoryStore
from dockcast.sources.notifications import entities_to_notifications, flatten_entities, once_each, read_notification_stream, read_notifications
from dockcast.sources.tables import events_history, events_requests
from dockcast.streaming.commits import Outbox, SnapshotLog, SumLog

BATCHES = 5  # the rows of a query are dealt to so many batches


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request's answer, with its time and a batch number."""
    requests = events_requests(spark, sf_dir)
    answers = predict(requests, events_history(spark, sf_dir, LOOKUP_CITIES), params=FLAGSHIP_PARAMS)
    times = requests.select("request_id", iso_utc("requested_at").alias("produced_at"))
    return settled(answers.join(times, "request_id").withColumn("batch", F.pmod("request_id", F.lit(BATCHES))))


def outbox_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer through the outbox, batch by batch.  A first attempt at each
    batch dies before its commit, and each is written once more after it."""
    answers = _answers(spark, sf_dir)
    outbox = Outbox(spark, _scratch(spark, "outbox"))
    for batch in range(BATCHES):
        mine = answers.where(F.col("batch") == batch).drop("batch", "produced_at")
        wrong = mine.withColumn("predictionValue", F.lit(-99))
        outbox.stage(wrong, batch)
        outbox.write(mine, batch)
        outbox.write(wrong, batch)
    return outbox.read().drop("batch_id")


def response_snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer of each station from a log of batches with compactions; the
    batches come in no order of time."""
    answers = _answers(spark, sf_dir)
    log = SnapshotLog(spark, _scratch(spark, "snapshot"), ["city", "idStation"], ["produced_at", "request_id"], compact_every=2)
    for batch in range(BATCHES):
        mine = answers.where(F.col("batch") == batch)
        log.add(mine.select("city", "idStation", "predictionValue", "predictionId", "status", "produced_at", "request_id"), batch)
    return log.read()


def notification_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request landed as a text file of notifications, every
    third delivered again in later files, read as a stream and answered for once."""
    root = _scratch(spark, "stream")
    notes = entities_to_notifications(events_requests(spark, sf_dir).withColumn("requested_at", F.lit(None).cast("timestamp_ntz")))
    notes = settled(notes.select("value"))
    notes.write.text(f"{root}/landing")
    again = F.pmod(F.xxhash64("value"), F.lit(3)) == 0
    outbox = Outbox(spark, f"{root}/outbox")

    def run() -> None:
        def keep(batch: DataFrame, number: int) -> None:
            requests = extract_requests(flatten_entities(batch), requested_at=F.lit("1970-01-01 00:00:00"))
            outbox.write(validate_requests(requests), number)

        stream = once_each(read_notification_stream(spark, f"{root}/landing", archive_dir=f"{root}/read"))
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()

    run()
    notes.where(again).write.mode("append").text(f"{root}/landing")
    run()
    return outbox.read().select("entity_id", "socket_id", "prediction_id", "city", "station_id", "weekday", "hour", "month", "status")


# --- what can't be answered or trained on ------------------------------------


def _damaged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications of all requests, of which five in ten are made wrong by their id:
    cut off, without entities, with a station, city or weekday that isn't one."""
    nth = F.pmod("request_id", F.lit(10))
    requests = events_requests(spark, sf_dir).withColumns(
        {
            "id_station": F.when(nth == 2, F.concat(F.lit("x"), F.col("id_station"))).otherwise(F.col("id_station")),
            "city": F.when(nth == 3, F.lit("Atlantis")).otherwise(F.col("city")),
            "weekday_raw": F.when(nth == 4, F.lit("9")).otherwise(F.col("weekday_raw")),
            # carried through: the time isn't part of the text
            "requested_at": F.col("request_id"),
        }
    )
    texts = entities_to_notifications(requests).withColumn("nth", F.pmod(F.col("requested_at"), F.lit(10)))
    empty = F.concat(F.lit('{"id":"urn:ngsi-ld:Notification:'), F.col("requested_at"), F.lit('","type":"Notification","data":[]}'))
    text = F.when(F.col("nth") == 0, F.left("value", F.lit(60))).when(F.col("nth") == 1, empty).otherwise(F.col("value"))
    return texts.select(text.alias("value"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of notifications routed in one pass; the texts that
    can't be answered with the reason, and how many of each reason were counted."""
    root = _scratch(spark, "letters")
    _damaged_texts(spark, sf_dir).write.text(f"{root}/landing")
    entities = flatten_entities(read_notifications(spark, f"{root}/landing"))
    judged = with_reason(validate_requests(extract_requests(entities, requested_at=F.lit("1970-01-01 00:00:00"))))
    counts = write_letters(judged.select("raw", "reason", "detail"), f"{root}/letters")
    bad = spark.read.parquet(f"{root}/letters/letter=bad")
    counted = spark.createDataFrame([(k, v) for k, v in counts.items() if k != "good"], "reason string, with_reason long")
    return bad.join(F.broadcast(counted), "reason").select("raw", "reason", "detail", "with_reason")


def training_csv_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training file with bad lines, read by the declared schema in one pass: sound
    rows with their columns, bad ones as their text."""
    root = _scratch(spark, "csv-letters")
    table = training_table_santander(spark, sf_dir)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    at = table.columns.index("id_station")
    bad_cell = [F.lit("n/a") if i == at else c for i, c in enumerate(cells)]
    nth = F.pmod("available_bikes", F.lit(5))
    line = F.when(nth == 0, F.concat_ws(",", *bad_cell)).when(nth == 1, F.concat_ws(",", *cells[:3])).otherwise(F.concat_ws(",", *cells))
    head = spark.createDataFrame([(",".join(table.columns),)], "value string")
    head.unionByName(table.select(line.alias("value"))).write.text(f"{root}/csv")
    write_letters(judged_training_csv(spark, f"{root}/csv", "Santander"), f"{root}/letters", reasons=(BAD_ROW,))
    return spark.read.parquet(f"{root}/letters").select(*table.columns, "raw", "reason", "letter")


def holdout_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten scored hold-out rows of a trained tree, as the training
    job shows them."""
    city = "Barcelona"
    rule = LAG_TREE_RULES[city]
    table = feat.lag_training_table(_levels(spark, sf_dir), rule, DAY)
    key = F.date_diff("slot_ts", F.lit("1970-01-01").cast("date")) + F.col("id_station")
    return preview(train_city(table, rule, split_key=key).test_predictions, rule)


def unknown_station_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that pass the range check, but whose station isn't in the dimension."""
    valid = validate_requests(events_requests(spark, sf_dir)).where(F.col("status") == OK)
    return unknown_stations(valid, stations_from_supplier(spark, sf_dir)).select("request_id", "city", "station_id")


# --- maintained profiles and backtests ---------------------------------------


def station_profile_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile from sums that batches maintain.  Readings come in five
    batches, of which the first holds wrong values that a later one corrects, and
    readings from before the history that expire."""
    hist = settled(events_history(spark, sf_dir))
    wrong = F.pmod("reading_id", F.lit(7)) == 0
    early = hist.withColumn("available", F.when(wrong, F.col("available") + 3).otherwise(F.col("available")))
    expired = hist.where(F.col("station_id") > 40).withColumn("ts", F.timestamp_add("HOUR", F.lit(-700), "ts"))
    log = SumLog(spark, _scratch(spark, "profile"), feat.PROFILE_KEY, feat.PROFILE_SUMS, compact_every=3)
    for batch in range(BATCHES):
        mine = F.pmod("reading_id", F.lit(BATCHES)) == batch
        log.add(feat.profile_partials(early.where(mine).unionByName(expired.where(mine))), batch)
    right = feat.profile_partials(early.where(wrong), -1).unionByName(feat.profile_partials(hist.where(wrong)))
    for _ in range(2):  # the second changes nothing
        log.add(right, BATCHES)
    log.add(feat.profile_partials(expired, -1), BATCHES + 1)
    return feat.profile_of_sums(log.read())


def backtest_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, F1, A2, A3: the forecast from every past slot, by city and step."""
    hist = events_history(spark, sf_dir, LOOKUP_CITIES)
    m = horizon_metrics(backtest(hist, FLAGSHIP_PARAMS))
    return m.select("city", "step", "rows", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "bias")])


# --- the history store -------------------------------------------------------

KEPT_DAYS = 10


def _stored_history(spark: SparkSession, sf_dir: str) -> tuple[HistoryStore, dt.datetime]:
    """The whole history appended in batches, with merges, of which the days that lie
    KEPT_DAYS and more before the newest reading have expired."""
    hist = settled(events_history(spark, sf_dir))
    store = HistoryStore(spark, _scratch(spark, "history"), fan=2, fanout=1)
    for batch in range(BATCHES):
        store.append(hist.where(F.pmod("reading_id", F.lit(BATCHES)) == batch), batch)
    newest = hist.agg(F.max("ts")).first()[0]
    store.expire((newest - dt.timedelta(days=KEPT_DAYS - 1)).date())
    return store, newest


def history_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store keeps."""
    store, _ = _stored_history(spark, sf_dir)
    store.sweep()
    return store.read().select("city", "station_id", iso_utc("ts").alias("ts"), "available", "reading_id")


def station_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings and half-hour slots of the last 24 hours for every station of the
    dimension; only the day folders of that span are opened."""
    store, newest = _stored_history(spark, sf_dir)
    recent = store.read(since=newest - dt.timedelta(hours=RETENTION_HOURS), until=newest)
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (CADENCE_MINUTES * 60_000_000))
    filled = recent.groupBy("city", "station_id", slot.alias("slot")).count()
    filled = filled.groupBy("city", "station_id").agg(F.sum("count").alias("n"), F.count("*").alias("slots"))
    zero = F.lit(0).cast("long")
    known = stations_from_supplier(spark, sf_dir).join(filled, ["city", "station_id"], "left")
    return known.select("city", "station_id", "name", F.coalesce("n", zero).alias("readings"), F.coalesce("slots", zero).alias("filled_slots"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "outbox_responses": outbox_responses,
    "response_snapshot_log": response_snapshot_log,
    "notification_stream": notification_stream,
    "dead_letters": dead_letters,
    "training_csv_letters": training_csv_letters,
    "holdout_preview": holdout_preview,
    "unknown_station_requests": unknown_station_requests,
    "station_profile_maintained": station_profile_maintained,
    "backtest_by_horizon": backtest_by_horizon,
    "history_store": history_store,
    "station_cadence": station_cadence,
}


def _dead_letters_sql() -> str:
    prop = lambda c: f"json_object('value', {c}, 'type', 'Property')"
    attrs = {
        "idStation": "id_station", "weekday": "CAST(weekday AS VARCHAR)", "hour": "CAST(hour AS VARCHAR)", "month": "CAST(month AS VARCHAR)",
        "city": "city", "predictionId": "prediction_id", "socketId": "socket_id",
    }
    entity = ", ".join(f"'{a}', {prop(c)}" for a, c in attrs.items())
    ranges = "CASE city " + " ".join(f"WHEN '{c}' THEN station_id BETWEEN {r.station_min} AND {r.station_max}" for c, r in CITY_RULES.items()) + " END"
    return f"""
WITH req AS ({oracle.requests_sql()}), wrong AS (
  SELECT * REPLACE (CASE nth WHEN 2 THEN 'x' || id_station ELSE id_station END AS id_station,
                    CASE nth WHEN 2 THEN NULL ELSE station_id END AS station_id,
                    CASE nth WHEN 3 THEN 'Atlantis' ELSE city END AS city, CASE nth WHEN 4 THEN 9 ELSE weekday END AS weekday)
  FROM (SELECT *, request_id % 10 AS nth FROM req)
), judged AS (
  SELECT *, CASE WHEN nth = 0 THEN 'broken_json' WHEN nth = 1 THEN 'no_entities' WHEN status0 <> 'ok' THEN status0 END AS reason
  FROM (SELECT val.*, nth FROM ({oracle.validated_sql().replace("FROM req", "FROM wrong")}) val)
), texts AS (
  SELECT *, 'urn:ngsi-ld:Notification:' || request_id AS note,
    CAST(json_object('id', 'urn:ngsi-ld:Notification:' || request_id, 'type', 'Notification', 'data',
      json_array(json_object('id', 'urn:ngsi-ld:ReqPrediction:' || request_id, 'type', 'ReqPrediction', {entity}))) AS VARCHAR) AS whole
  FROM judged WHERE reason IS NOT NULL
)
SELECT CASE nth WHEN 0 THEN left(whole, 60) WHEN 1 THEN '{{"id":"' || note || '","type":"Notification","data":[]}}' ELSE whole END AS raw, reason,
       CASE reason WHEN 'malformed' THEN array_to_string(list_filter([
              CASE WHEN station_id IS NULL THEN 'idStation' END, CASE WHEN hour IS NULL THEN 'hour' END], lambda x: x IS NOT NULL), ',')
            WHEN 'invalid_request' THEN array_to_string(list_filter([
              CASE WHEN NOT ({ranges}) THEN 'idStation' END, CASE WHEN hour NOT BETWEEN 0 AND 23 THEN 'hour' END,
              CASE WHEN weekday NOT BETWEEN 1 AND 7 THEN 'weekday' END], lambda x: x IS NOT NULL), ',') END AS detail,
       count(*) OVER (PARTITION BY reason) AS with_reason
FROM texts"""


def _csv_letters_sql() -> str:
    columns = ["available_bikes", "modified", "id_station", "five_before", "ten_before", "fifteen_before", "twenty_before"]
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
    sound = ", ".join(f"CASE WHEN available_bikes % 5 > 1 THEN {c} END AS {c}" for c in columns)
    bad_cell = " || ',' || ".join("'n/a'" if c == "id_station" else text(c) for c in columns)
    short = " || ',' || ".join(text(c) for c in columns[:3])
    return f"""
SELECT {sound}, CASE available_bikes % 5 WHEN 0 THEN {bad_cell} WHEN 1 THEN {short} END AS raw,
       CASE WHEN available_bikes % 5 < 2 THEN 'bad_row' END AS reason,
       CASE WHEN available_bikes % 5 < 2 THEN 'bad' ELSE 'good' END AS letter FROM ({OTHER_SQL["training_table_santander"]}) t"""


def _holdout_preview_sql() -> str:
    hist = f"SELECT * REPLACE (CAST(available // {LEVEL} AS INTEGER) AS available) FROM ({oracle.history_sql()}) h"
    rule = LAG_TREE_RULES["Barcelona"]
    return f"""
WITH hist AS ({hist}), {_lag_groups_sql("Barcelona")}, grid AS ({_grid_sql("Barcelona", "day")}), t AS ({_lag_table_sql(rule)})
SELECT list_filter((SELECT groups FROM l_Barcelona), lambda g: three_before <= g.upto)[1].p AS prediction, available_bikes, three_before
FROM t WHERE three_before IS NOT NULL AND (date_diff('day', DATE '1970-01-01', CAST(slot_ts AS DATE)) + id_station) % 10 >= 8
ORDER BY available_bikes, three_before, prediction LIMIT 10"""


def _backtest_sql() -> str:
    rules = {c: CITY_RULES[c] for c in LOOKUP_CITIES}
    most = max(r.unrolled_steps for r in rules.values())
    cities = ", ".join(f"'{c}'" for c in rules)
    chain = []
    for i in range(1, most + 1):
        arms = " ".join(f"WHEN '{c}' THEN {oracle.mean_of_lags_sql(r)}" for c, r in rules.items() if r.unrolled_steps >= i)
        chain.append(f"""z{i} AS (SELECT * REPLACE ({oracle.round_half_up_float_sql(f"p{i}")} AS s1, s1 AS s2, s2 AS s3, s3 AS s4)
  FROM (SELECT *, CASE city {arms} END AS p{i} FROM z{i - 1}))""")
    seconds = "CASE city " + " ".join(f"WHEN '{c}' THEN {r.step * DAY}" for c, r in rules.items()) + " END"
    made = " UNION ALL ".join(f"SELECT city, station_id, slot_ts, {i} AS step, p{i} AS p FROM z{most} WHERE p{i} IS NOT NULL" for i in range(1, most + 1))
    return f"""
WITH hist AS ({oracle.history_sql()}), grid AS (
  SELECT * FROM (SELECT city, station_id, date_trunc('day', ts) AS slot_ts, arg_max({{'a': available}}, (ts, reading_id)).a AS available
  FROM hist WHERE city IN ({cities}) GROUP BY city, station_id, date_trunc('day', ts)) g WHERE available IS NOT NULL
), val AS (
  SELECT row_number() OVER (ORDER BY city, station_id, slot_ts) AS request_id, city, station_id, slot_ts,
         slot_ts + INTERVAL {DAY} SECOND AS requested_at, 'ok' AS status0 FROM grid
), lk AS ({oracle.lookups_sql(DAY)}), lu AS ({oracle.looked_up_sql()}),
z0 AS (SELECT *, slot1 AS s1, slot2 AS s2, slot3 AS s3, slot4 AS s4 FROM lu WHERE status = 'ok'),
{", ".join(chain)}, made AS ({made})
SELECT m.city, step, count(*) AS rows, round(sqrt(avg((p - available) * (p - available))), 6) AS rmse,
       round(avg(abs(p - available)), 6) AS mae, round(avg(p - available), 6) AS bias
FROM made m JOIN grid g ON g.city = m.city AND g.station_id = m.station_id AND g.slot_ts = m.slot_ts + to_seconds(step * ({seconds.replace("city", "m.city")}))
GROUP BY m.city, step"""


ORACLE_SQL: dict[str, str] = {
    "outbox_responses": oracle.prediction_pipeline_sql(DAY),
    "response_snapshot_log": OTHER_SQL["response_snapshot"],
    "notification_stream": OTHER_SQL["notification_roundtrip"],
    "dead_letters": _dead_letters_sql(),
    "training_csv_letters": _csv_letters_sql(),
    "holdout_preview": _holdout_preview_sql(),
    "unknown_station_requests": f"""WITH req AS ({oracle.requests_sql()}), val AS ({oracle.validated_sql()}), st AS ({_stations_sql()})
SELECT request_id, city, station_id FROM val WHERE status0 = 'ok' AND NOT EXISTS (
  SELECT 1 FROM st WHERE st.city = val.city AND st.station_id = val.station_id)""",
    "station_profile_maintained": OTHER_SQL["station_profile"],
    "backtest_by_horizon": _backtest_sql(),
    "history_store": f"""WITH hist AS ({oracle.history_sql()})
SELECT city, station_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, available, reading_id FROM hist
WHERE CAST(ts AS DATE) > (SELECT CAST(max(ts) AS DATE) FROM hist) - {KEPT_DAYS}""",
    "station_cadence": f"""WITH hist AS ({oracle.history_sql()}), st AS ({_stations_sql()}), recent AS (
  SELECT city, station_id, count(*) AS n, count(DISTINCT time_bucket(INTERVAL {CADENCE_MINUTES} MINUTE, ts)) AS slots FROM hist
  WHERE ts > (SELECT max(ts) FROM hist) - INTERVAL {RETENTION_HOURS} HOUR GROUP BY city, station_id)
SELECT st.city, st.station_id, st.name, coalesce(n, 0) AS readings, coalesce(slots, 0) AS filled_slots
FROM st LEFT JOIN recent r ON r.city = st.city AND r.station_id = st.station_id""",
}
