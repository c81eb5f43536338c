"""Commits, snapshot log, redelivery, model versions, landing folder."""

import datetime as dt
import glob
import os
import random
import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from dockcast.config import DAY, RunParams
from dockcast.operators.responses import latest_per_key
from dockcast.plans.models import CurrentModels, ModelStore
from dockcast.sources.notifications import entities_to_notifications, once_each, read_notification_stream
from dockcast.sources.tables import events_history, events_requests
from dockcast.streaming.commits import Commits, Files, Outbox, SnapshotLog
from dockcast.streaming.stream import make_batch_scorer, snapshot_log

from conftest import SF_SMALL

AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- commits and outbox ------------------------------------------------------


def test_a_commit_is_made_once_and_never_changes(spark):
    c = Commits(Files(spark, folder("commits")), "_c")
    assert c.numbers() == []
    assert c.put(3, {"a": "é"}) and not c.put(3, {"a": 2}) and c.put(1, {})
    assert c.numbers() == [1, 3] and c.get(3) == {"a": "é"}
    c.forget(3)
    assert c.numbers() == [1]


def test_a_writer_that_dies_leaves_nothing_readable(spark, monkeypatch):
    box = Outbox(spark, folder("outbox"))
    first, second = spark.range(5), spark.range(100, 107)
    assert box.read("id long").count() == 0
    assert box.write(first, 0)
    box.stage(second, 1)  # died before the commit
    assert rows(box.read().select("id")) == rows(first)
    # died between the move and the commit
    monkeypatch.setattr(Commits, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        box.write(second.union(second), 1)
    monkeypatch.undo()
    assert rows(box.read().select("id")) == rows(first) and not box.committed(1)
    # the replay replaces what was left, and a second one writes nothing
    assert box.write(second, 1) and not box.write(second.union(second), 1)
    assert rows(box.read().select("id")) == rows(first.union(second))
    assert rows(box.read().select("batch_id").distinct()) == [(0,), (1,)]
    box.vacuum()
    assert not glob.glob(f"{box.path}/_staged/*") and box.read().count() == 12


def test_a_batch_that_died_after_its_answers_ends_its_snapshot(spark, monkeypatch):
    root = folder("half")
    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    for fmt in ("parquet", "text"):
        score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/{fmt}", f"{root}/snap-{fmt}",
                                  params=RunParams(lag_unit=DAY), as_of=lambda b: AS_OF, outbox_format=fmt)
        monkeypatch.setattr(SnapshotLog, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            score(notes, 0)
        monkeypatch.undo()
        assert snapshot_log(spark, f"{root}/snap-{fmt}").read() is None
        score(notes, 0)
        assert snapshot_log(spark, f"{root}/snap-{fmt}").read().count() > 0
        read = Outbox(spark, f"{root}/{fmt}", fmt).read()
        assert read.count() == notes.count()
    a, b = (rows(snapshot_log(spark, f"{root}/snap-{f}").read().drop("request_id", "produced_at")) for f in ("parquet", "text"))
    assert a == b


# --- snapshot log ------------------------------------------------------------

SNAP = "city string, idStation string, value int, at int, request_id long"


def log(spark, path, **kw):
    return SnapshotLog(spark, path, ["city", "idStation"], ["at", "request_id"], **kw)


def test_snapshot_log_equals_the_last_row_of_each_key(spark):
    rng = random.Random(2)
    path, seen = folder("log"), []
    for batch in range(7):
        new = [(rng.choice(["B", "S", None]), str(rng.randint(1, 40)), rng.randint(0, 9), rng.randint(0, 50), batch * 100 + i) for i in range(rng.choice([1, 30, 60]))]
        seen += new
        assert log(spark, path, buckets=4, compact_every=3).add(spark.createDataFrame(new, SNAP), batch)
        got = rows(log(spark, path, buckets=4).read().select("city", "idStation", "value", "at", "request_id"))
        want = rows(latest_per_key(spark.createDataFrame(seen, SNAP), ["city", "idStation"], ["at", "request_id"]).select("city", "idStation", "value", "at", "request_id"))
        assert got == want, batch
        # a replay adds nothing, whether or not its delta was compacted
        assert not log(spark, path, buckets=4).add(spark.createDataFrame([("B", "1", 99, 999, 1)], SNAP), batch)
    assert log(spark, folder("log")).read() is None


def test_a_batch_writes_its_own_stations_and_compaction_the_touched_buckets(spark):
    path = folder("log")
    big = [("B", str(i), 1, 0, i) for i in range(3000)]
    log(spark, path, compact_every=1).add(spark.createDataFrame(big, SNAP), 0)
    before = set(glob.glob(f"{path}/base/**/*.parquet", recursive=True))
    s = log(spark, path, compact_every=2)
    s.add(spark.createDataFrame([("B", "7", 2, 5, 9000)] * 3, SNAP), 1)
    (delta,) = (spark.read.parquet(f"{path}/{s.deltas.get(1)['folder']}"),)
    assert delta.count() == 1 and set(glob.glob(f"{path}/base/**/*.parquet", recursive=True)) == before
    s.add(spark.createDataFrame([("B", "7", 3, 6, 9001)], SNAP), 2)
    new = set(glob.glob(f"{path}/base/**/*.parquet", recursive=True)) - before
    assert {p.split("b=")[1].split("/")[0] for p in new} == {str(delta.first()._bucket)}
    assert s.read().count() == 3000 and s.read().where("idStation = '7'").first().value == 3


def test_a_reader_survives_a_compaction_and_old_folders_go(spark):
    path = folder("log")
    s = log(spark, path, compact_every=2, buckets=2)
    s.add(spark.createDataFrame([("B", str(i), 0, 0, i) for i in range(50)], SNAP), 0)
    reading = s.read()  # planned on the folders of now
    s.add(spark.createDataFrame([("B", "1", 1, 1, 100)], SNAP), 1)
    assert reading.count() == 50
    for batch in range(2, 12):
        s.add(spark.createDataFrame([("B", str(batch), 1, batch, 100 + batch)], SNAP), batch)
    assert len(s.bases.numbers()) == 2 and len(s.deltas.numbers()) <= 4
    assert len(os.listdir(f"{path}/delta")) <= 4 + 1 and s.read().count() == 50


def test_a_compaction_that_dies_changes_nothing(spark, monkeypatch):
    path = folder("log")
    s = log(spark, path, compact_every=100)
    for batch in range(3):
        s.add(spark.createDataFrame([("B", str(batch), batch, batch, batch)], SNAP), batch)
    want = rows(s.read())
    put = Commits.put
    monkeypatch.setattr(Commits, "put", lambda self, n, c: (_ for _ in ()).throw(OSError("lost")) if self.name == "_bases" else put(self, n, c))
    with pytest.raises(OSError):
        s.compact()
    monkeypatch.undo()
    assert rows(s.read()) == want
    s.compact()
    assert rows(s.read()) == want and s._fresh() == []


# --- redelivered notifications ----------------------------------------------


def drained(spark, root, window="10 minutes", **source):
    """Texts that a run of the stream lets through, in one list."""
    out = []
    stream = once_each(read_notification_stream(spark, f"{root}/landing", **source), window)
    q = stream.writeStream.foreachBatch(lambda df, n: out.extend(r.value for r in df.collect()))
    q.option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start().awaitTermination(300)
    return sorted(out)


def land(spark, root, *lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{root}/landing")


def test_redelivered_notifications_are_dropped(spark):
    root = folder("again")
    a, b, changed = '{"id": "n1", "data": []}', '{"id": "n2", "data": []}', '{"id": "n1", "data": [1]}'
    anonymous, broken = '{"data": []}', '{"id": "n3"'
    land(spark, root, a, a, b, anonymous, anonymous, broken, broken, '{"id": null}')
    assert drained(spark, root) == sorted([a, b, anonymous, anonymous, broken, broken, '{"id": null}'])
    # in a later batch and after a restart, with another body too
    land(spark, root, b, changed, '{"id": "n4"}')
    assert drained(spark, root) == ['{"id": "n4"}']


def test_a_notification_is_never_too_late(spark):
    root = folder("late")
    a = '{"id": "n1"}'
    land(spark, root, a)
    assert drained(spark, root, window="1 second") == [a]
    import time

    for i in range(3):  # the watermark follows the batches
        time.sleep(1.2)
        land(spark, root, '{"id": "other%d"}' % i)
        drained(spark, root, window="1 second")
    old = glob.glob(f"{root}/landing/*.txt")
    land(spark, root, a, '{"id": "slow"}')
    new = [f for f in glob.glob(f"{root}/landing/*.txt") if f not in old]
    os.utime(new[0], (time.time() - 86_400,) * 2)  # a file of the day before
    assert drained(spark, root, window="1 second") == [a, '{"id": "slow"}']


def test_landing_files_are_archived_and_read_once(spark):
    root = folder("landing")
    seen = []
    for i in range(4):
        for j in range(3):
            land(spark, root, '{"id": "%d-%d"}' % (i, j))
        seen += drained(spark, root, max_bytes_per_trigger=20, archive_dir=f"{root}/archive")
    assert sorted(seen) == sorted('{"id": "%d-%d"}' % (i, j) for i in range(4) for j in range(3))
    left, kept = glob.glob(f"{root}/landing/*.txt"), glob.glob(f"{root}/archive/**/*.txt", recursive=True)
    assert kept and len(left) + len(kept) == 12 and len(left) <= 6


# --- model versions ----------------------------------------------------------


def constant(spark, inputs, value):
    """A fitted pipeline whose tree says ``value``."""
    df = spark.createDataFrame([tuple([0] * len(inputs) + [float(value)])] * 2, [*inputs, "label"])
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    return PipelineModel([assembler, DecisionTreeRegressor(seed=1).fit(assembler.transform(df))])


def test_versions_are_kept_until_pruned(spark):
    store = ModelStore(spark, folder("models"))
    with pytest.raises(FileNotFoundError):
        store.load("Malaga")
    for v in (1, 2, 3):
        assert store.publish("Malaga", constant(spark, ["name"], v)) == v
    df = spark.createDataFrame([(1,)], "name int")
    assert [store.load("Malaga", v).transform(df).first().prediction for v in (1, 2, None)] == [1.0, 2.0, 3.0]
    store.prune("Malaga", keep=1)
    assert store.versions("Malaga") == [3] and store.load("Malaga").transform(df).first().prediction == 3.0
    with pytest.raises(FileNotFoundError):
        store.load("Malaga", 1)


def test_a_service_takes_up_a_retrained_model_between_batches(spark):
    root = folder("retrain")
    store = ModelStore(spark, f"{root}/models")
    cities = {"Barcelona": ["three_before"], "Santander": ["five_before"], "Malaga": ["name"]}
    for city, inputs in cities.items():
        store.publish(city, constant(spark, inputs, 4))
    models = CurrentModels(store, list(cities))
    notes = entities_to_notifications(events_requests(spark, SF_SMALL)).select("value")
    score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/outbox", params=RunParams(lag_unit=DAY), as_of=lambda b: AS_OF, models=models)
    score(notes, 0)
    store.publish("Malaga", constant(spark, ["name"], 7))
    store.prune("Malaga", keep=1)
    score(notes, 1)
    score(notes, 0)  # a replay of what is committed keeps its version
    got = Outbox(spark, f"{root}/outbox").read().where("status = 'ok'").groupBy("batch_id", "city", "model_version").agg(F.collect_set("predictionValue").alias("v")).collect()
    by = {(r.batch_id, r.city): (r.model_version, r.v) for r in got}
    assert by[0, "Malaga"] == (1, [40]) and by[1, "Malaga"] == (2, [70])
    assert by[0, "Barcelona"] == by[1, "Barcelona"] == (1, [4])
    with pytest.raises(FileNotFoundError):
        CurrentModels(store, ["Nowhere"])
