"""The prediction service as a Structured Streaming query.

Notifications land as JSON lines in a folder (S1).  Each micro-batch goes
through ``foreachBatch`` into exactly the batch plan (W2), so stream and
batch answers are the same by construction:

* "now" of a batch is one literal (``as_of``), kept for replays, so history
  retention (S5) bounds are constants that prune day folders and are pushed
  into the Parquet scan; the retention covers the largest lookback;
* responses are staged and committed once per batch id (S10): readers see whole
  batches, and a replay of a committed batch writes nothing (W4; progress lives
  in the checkpoint);
* a notification that the broker delivers again is dropped by its id (W4);
* the last-write-wins snapshot (S11) is a log: a batch adds its last answer of each
  station, and now and then the log is compacted;
* a retrained model is taken up between two batches (S9), and every answer names the
  version that made it;
* an empty batch writes nothing (W3).
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dockcast.config import CITY_RULES, NO_HISTORY, OK, RETENTION_HOURS, RunParams
from dockcast.functions import ntz_literal
from dockcast.operators.requests import extract_requests, validate_requests, with_reason
from dockcast.plans.models import CurrentModels
from dockcast.plans.predict import predict, retain
from dockcast.session import path_exists
from dockcast.sources.notifications import flatten_entities, once_each, read_notification_stream
from dockcast.streaming.commits import Outbox, SnapshotLog


def utc_now(_batch_id: int) -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


SNAPSHOT_KEY = ["city", "idStation"]
SNAPSHOT_ORDER = ["produced_at", "request_id"]


def snapshot_log(spark: SparkSession, snapshot_dir: str, compact_every: int = 8) -> SnapshotLog:
    return SnapshotLog(spark, snapshot_dir, SNAPSHOT_KEY, SNAPSHOT_ORDER, compact_every=compact_every)


def batch_time(spark: SparkSession, outbox_dir: str, batch_id: int, as_of: Callable[[int], dt.datetime]) -> dt.datetime:
    """"Now" of a batch, kept beside the outbox: a replay answers with the same."""
    path = f"{outbox_dir}/_as_of/{batch_id}"
    if not path_exists(spark, path):
        now = as_of(batch_id)
        kept = spark.createDataFrame([(now.isoformat(),)], "as_of string").coalesce(1)
        kept.write.mode("overwrite").text(path)
        return now
    return dt.datetime.fromisoformat(spark.read.text(path).first()[0])


def history_seconds(params: RunParams, rules=CITY_RULES, retention_hours: int | None = None) -> int:
    """How much history a batch reads: the retention, and never less than the
    largest lookback in the run's unit."""
    lookback = max((r.lookback for r in rules.values() if r.lookups), default=0) * params.lag_unit
    if retention_hours is None:
        return max(RETENTION_HOURS * 3600, lookback)
    if retention_hours * 3600 < lookback:
        raise ValueError(f"retention of {retention_hours} h is shorter than the lookback of {lookback} s")
    return retention_hours * 3600


def make_batch_scorer(
    history: Callable[[dt.datetime, dt.datetime], DataFrame],
    outbox_dir: str,
    snapshot_dir: str | None = None,
    predictor=None,
    params: RunParams = RunParams(),
    as_of: Callable[[int], dt.datetime] = utc_now,
    retention_hours: int | None = None,
    rules=CITY_RULES,
    outbox_format: str = "parquet",
    compact_every: int = 8,
    models: CurrentModels | None = None,
    rejected_dir: str | None = None,
):
    """The ``foreachBatch`` function (also callable on a static DataFrame).

    ``history(since, until)`` reads the readings after ``since`` up to ``until``,
    so a partitioned store is pruned to the days a batch can need; without
    ``retention_hours`` the span follows from the lookback and the unit.
    """
    span = history_seconds(params, rules, retention_hours)
    # one "now" for the whole batch: its bounds need no pass over the requests
    params = dataclasses.replace(params, bound_history=False)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        outbox = Outbox(spark, outbox_dir, outbox_format)
        # the broker's form has the payload alone; the answers are kept beside it
        answers = Outbox(spark, f"{outbox_dir}/_answers") if outbox_format == "text" else outbox
        if not answers.committed(batch_id):
            requests = extract_requests(flatten_entities(batch)).persist()
            try:
                if requests.isEmpty():  # W3
                    return
                now = batch_time(spark, outbox_dir, batch_id, as_of)
                if rejected_dir:
                    judged = with_reason(validate_requests(requests.withColumn("requested_at", ntz_literal(now))))
                    letters = judged.where("reason is not null").select("raw", "reason", "detail", "city", "entity_id")
                    Outbox(spark, rejected_dir).write(letters, batch_id, {"as_of": now.isoformat()})
                versions = models.refresh() if models else {}
                since = now - dt.timedelta(seconds=span)
                hist = retain(history(since, now), now, span / 3600)
                scorer = models.predictor if models else predictor
                responses = predict(requests.withColumn("requested_at", ntz_literal(now)), hist, scorer, params, rules, with_lags=False)
                responses = responses.select("*", _version(versions), ntz_literal(now).alias("produced_at"), F.lit(batch_id).cast("long").alias("batch_id"))
                answers.write(responses, batch_id, {"as_of": now.isoformat(), "models": versions})
            finally:
                requests.unpersist()
        made = spark.read.parquet(answers.folder(batch_id))
        if answers is not outbox:
            outbox.write(made.select("payload"), batch_id)
        if snapshot_dir:
            # keys are known stations only, so clients can't grow it
            entity = made.where(F.col("status").isin(OK, NO_HISTORY)).select("city", "idStation", "predictionValue", "predictionId", "status", "payload", "produced_at", "request_id")
            snapshot_log(spark, snapshot_dir, compact_every).add(entity, batch_id)

    return score_batch


def _version(versions: dict[str, int]):
    """Number of the model that scores the row's city; null without a store."""
    number = F.lit(None).cast("int")
    for city, v in versions.items():
        number = F.when(F.col("city") == city, v).otherwise(number)
    return number.alias("model_version")


def start_prediction_stream(
    spark: SparkSession,
    landing_dir: str,
    history: Callable[[dt.datetime, dt.datetime], DataFrame],
    outbox_dir: str,
    checkpoint_location: str,
    snapshot_dir: str | None = None,
    predictor=None,
    params: RunParams = RunParams(),
    as_of: Callable[[int], dt.datetime] = utc_now,
    available_now: bool = False,
    interval: str = "1 second",
    max_files_per_trigger: int | None = None,
    retention_hours: int | None = None,
    outbox_format: str = "parquet",
    compact_every: int = 8,
    models: CurrentModels | None = None,
    redelivery_window: str | None = "10 minutes",
    max_bytes_per_trigger: int | str | None = None,
    archive_dir: str | None = None,
    rejected_dir: str | None = None,
) -> StreamingQuery:
    """Start the service; ``available_now`` drains the landing folder and stops."""
    raw = read_notification_stream(spark, landing_dir, max_files_per_trigger, max_bytes_per_trigger, archive_dir)
    if redelivery_window:
        raw = once_each(raw, redelivery_window)
    scorer = make_batch_scorer(
        history, outbox_dir, snapshot_dir, predictor, params, as_of, retention_hours,
        outbox_format=outbox_format, compact_every=compact_every, models=models, rejected_dir=rejected_dir,
    )
    writer = raw.writeStream.foreachBatch(scorer).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
