"""Stream output equals batch output; restarts add nothing."""

import datetime as dt
import glob
import tempfile

import pytest
from pyspark.sql import functions as F

from dockcast.config import DAY, RunParams
from dockcast.operators.requests import extract_requests
from dockcast.plans.predict import predict, retain
from dockcast.sources.notifications import entities_to_notifications, flatten_entities
from dockcast.sources.tables import events_history, events_requests
from dockcast.sources.history import read_history, write_history
from dockcast.streaming.stream import history_seconds, make_batch_scorer, snapshot_log, start_prediction_stream

from conftest import SF_SMALL

AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)
PARAMS = RunParams(lag_unit=DAY)


def test_stream_equals_batch_and_restart_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    landing, outbox, ckpt, snap = (f"{root}/{x}" for x in ("landing", "outbox", "ckpt", "snapshot"))
    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    notes.repartition(3).write.text(landing)  # three files -> with 1 file per trigger, three batches
    history = lambda since=None, until=None: events_history(spark, SF_SMALL)
    kw = dict(snapshot_dir=snap, params=PARAMS, as_of=lambda b: AS_OF, available_now=True,
              max_files_per_trigger=1, retention_hours=24 * 30)
    q = start_prediction_stream(spark, landing, history, outbox, ckpt, **kw)
    q.awaitTermination(300)
    streamed = spark.read.parquet(outbox)
    assert streamed.select("batch_id").distinct().count() == 3

    raw = spark.read.text(landing)
    req = extract_requests(flatten_entities(raw), requested_at=F.lit(AS_OF))
    batch = predict(req, retain(history(), AS_OF, 24 * 30), params=PARAMS, with_lags=False)
    cols = sorted(c for c in batch.columns if c != "request_id")  # ids are per batch
    a = sorted(tuple(r) for r in streamed.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) == raw.count()

    # restart on the same checkpoint: nothing new, nothing duplicated
    q2 = start_prediction_stream(spark, landing, history, outbox, ckpt, **kw)
    q2.awaitTermination(300)
    assert spark.read.parquet(outbox).count() == len(a)

    # snapshot: one row per (city, station), the newest answer
    s = snapshot_log(spark, snap).read()
    assert s.count() == s.select("city", "idStation").distinct().count()
    known = streamed.where("status in ('ok', 'no_history')")
    assert s.count() == known.select("city", "idStation").distinct().count() > 0


def test_replayed_batch_overwrites_its_output(spark):
    root = tempfile.mkdtemp(prefix="replay-")
    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/outbox", params=PARAMS,
                              as_of=lambda b: AS_OF, retention_hours=None)
    score(notes, 0)
    score(notes, 0)  # same batch id again, as after a failure
    assert spark.read.parquet(f"{root}/outbox").count() == notes.count()


def test_day_unit_serving_equals_the_uncut_batch(spark):
    """The retention follows from lookback x unit, so no answer changes."""
    root = tempfile.mkdtemp(prefix="unit-")
    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/outbox", params=PARAMS, as_of=lambda b: AS_OF)
    score(notes, 0)
    req = extract_requests(flatten_entities(notes), requested_at=F.lit(AS_OF))
    batch = predict(req, events_history(spark, SF_SMALL), params=PARAMS, with_lags=False)
    cols = ["predictionId", "predictionValue", "status"]
    assert sorted(map(tuple, spark.read.parquet(f"{root}/outbox").select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    assert batch.where("status = 'ok'").count() > 0
    with pytest.raises(ValueError):
        make_batch_scorer(None, root, params=PARAMS, retention_hours=24)


def test_service_history_read_prunes_day_folders(spark):
    root = tempfile.mkdtemp(prefix="prune-")
    write_history(events_history(spark, SF_SMALL), f"{root}/history")
    span = history_seconds(PARAMS)
    plans = []

    def history(since, until):
        assert until - since == dt.timedelta(seconds=span)
        df = read_history(spark, f"{root}/history", since, until)
        plans.append(retain(df, until, span / 3600)._jdf.queryExecution().executedPlan().toString())
        return df

    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    make_batch_scorer(history, f"{root}/outbox", params=PARAMS, as_of=lambda b: AS_OF)(notes, 0)
    filters = plans[0].split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in filters


def test_replay_keeps_its_time_and_reads_the_snapshot_before_it(spark):
    root = tempfile.mkdtemp(prefix="snap-")
    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    clock = iter(AS_OF + dt.timedelta(days=d) for d in range(9))
    score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/outbox", f"{root}/snap",
                              params=PARAMS, as_of=lambda b: next(clock))
    read = lambda p: sorted(map(tuple, spark.read.parquet(p).collect()), key=repr)
    score(notes.limit(400), 0)
    score(notes, 1)
    snap = lambda: sorted(map(tuple, snapshot_log(spark, f"{root}/snap").read().collect()), key=repr)
    first = read(f"{root}/outbox/batch_id=1"), snap()
    score(notes, 1)  # replay: the clock has moved on, the answers have not
    assert (read(f"{root}/outbox/batch_id=1"), snap()) == first


def test_empty_batch_writes_nothing(spark):
    root = tempfile.mkdtemp(prefix="empty-")
    score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/outbox", as_of=lambda b: AS_OF)
    score(spark.createDataFrame([], "value string"), 0)
    assert not glob.glob(f"{root}/outbox/*")


def test_text_outbox_holds_one_payload_per_request(spark):
    import json

    root = tempfile.mkdtemp(prefix="textbox-")
    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/outbox", params=PARAMS,
                              as_of=lambda b: AS_OF, retention_hours=None, outbox_format="text")
    score(notes, 7)
    lines = spark.read.text(f"{root}/outbox/batch_id=7").collect()
    assert len(lines) == notes.count()
    first = json.loads(lines[0].value)
    assert set(first) == {"socketId", "predictionId", "predictionValue", "idStation", "weekday", "hour", "month", "city"}
