"""Stores that are maintained equal what is recomputed."""

import datetime as dt
import glob
import random
import tempfile

import pytest

from dockcast.config import BARCELONA, HOUR, RunParams
from dockcast.operators import features as feat
from dockcast.operators.backtest import backtest, horizon_metrics
from dockcast.sources.history_store import HistoryStore
from dockcast.streaming.commits import Commits, SumLog

T0 = dt.datetime(2024, 1, 1)
HIST = "city string, station_id int, ts timestamp_ntz, available int, reading_id long"


def readings(rng, n, first=0, days=6):
    return [
        (rng.choice(["Barcelona", "Santander", None]), rng.choice([1, 2, None]), T0 + dt.timedelta(minutes=rng.randint(0, days * 1440)), rng.choice([None, 0, 3, 9]), first + i)
        for i in range(n)
    ]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_store_after_many_appends_opens_few_folders(spark):
    rng, path, all_rows = random.Random(1), tempfile.mkdtemp(prefix="store-"), []
    store = HistoryStore(spark, path, fan=3, fanout=1)
    assert store.read().count() == 0
    for batch in range(30):
        new = readings(rng, 5, batch * 10, days=2)
        all_rows += new
        assert store.append(spark.createDataFrame(new, HIST), batch)
        assert not store.append(spark.createDataFrame(new, HIST), batch)
        folders = [f["name"] for f in store.manifest()["folders"]]
        assert len(folders) <= 2 * 4  # below three of each power of three up to 30
        assert len(glob.glob(f"{path}/part=*")) <= len(folders) + 4
    assert rows(store.read()) == sorted(all_rows, key=repr)
    since, until = T0 + dt.timedelta(hours=20), T0 + dt.timedelta(hours=30)
    assert rows(store.read(since, until)) == sorted((r for r in all_rows if since < r[2] <= until), key=repr)


def test_expired_days_go_and_a_reader_ends_well(spark):
    rng, path = random.Random(2), tempfile.mkdtemp(prefix="store-")
    store, all_rows = HistoryStore(spark, path, fan=10, fanout=1), readings(random.Random(2), 60)
    store.append(spark.createDataFrame(all_rows, HIST), 0)
    reading = store.read()
    store.expire((T0 + dt.timedelta(days=3)).date())
    store.sweep()
    assert reading.count() == 60  # planned before the change
    want = sorted((r for r in all_rows if r[2] >= T0 + dt.timedelta(days=3)), key=repr)
    assert rows(store.read()) == want
    store.append(spark.createDataFrame(readings(rng, 3, 100, days=1), HIST), 1)  # late and expired
    store.sweep()
    assert rows(store.read()) == want
    days = {p.split("day=")[1] for p in glob.glob(f"{path}/part=*/city=*/day=*")}
    assert all(d >= "2024-01-04" for d in days)
    store.expire(T0.date())  # never backwards
    assert rows(store.read()) == want


def test_a_merge_that_dies_loses_nothing(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="store-")
    store, all_rows = HistoryStore(spark, path, fan=2, fanout=1), readings(random.Random(3), 20)
    store.append(spark.createDataFrame(all_rows[:10], HIST), 0)
    put, calls = Commits.put, []

    def dies_second(self, number, content):
        calls.append(number)
        if len(calls) == 2:
            raise OSError("lost")
        return put(self, number, content)

    monkeypatch.setattr(Commits, "put", dies_second)
    with pytest.raises(OSError):
        store.append(spark.createDataFrame(all_rows[10:], HIST), 1)
    monkeypatch.undo()
    assert rows(store.read()) == sorted(all_rows, key=repr)
    assert not store.append(spark.createDataFrame(all_rows[10:], HIST), 1)
    assert store.append(spark.createDataFrame([], HIST), 2)
    assert rows(store.read()) == sorted(all_rows, key=repr)


def test_maintained_profile_equals_the_recomputed_one(spark):
    rng, path = random.Random(4), tempfile.mkdtemp(prefix="profile-")
    live = {}
    log = SumLog(spark, path, feat.PROFILE_KEY, feat.PROFILE_SUMS, compact_every=2)
    for batch in range(6):
        new = {r[4]: r for r in readings(rng, 25, batch * 100)}
        gone = {i: live[i] for i in rng.sample(sorted(live), min(len(live), 12))}  # expired or corrected
        for i in gone:
            del live[i]
        live |= new
        delta = feat.profile_partials(spark.createDataFrame(list(new.values()), HIST))
        if gone:
            delta = delta.unionByName(feat.profile_partials(spark.createDataFrame(list(gone.values()), HIST), -1))
        log.add(delta, batch)
        assert not log.add(delta, batch)
        assert rows(feat.profile_of_sums(log.read())) == rows(feat.station_profile(spark.createDataFrame(list(live.values()), HIST)))
    everything = feat.profile_partials(spark.createDataFrame(list(live.values()), HIST), -1)
    log.add(everything, 99)
    assert feat.profile_of_sums(log.read()).count() == 0


def test_backtest_compares_each_step_with_its_reading(spark):
    """One station, a reading in every hour but one: the recursion by hand."""
    value = lambda h: (h * 7) % 23
    hist = [("Barcelona", 5, T0 + dt.timedelta(hours=h, minutes=30), value(h), h) for h in range(60) if h != 40]
    got = backtest(spark.createDataFrame(hist, HIST), RunParams(lag_unit=HOUR)).collect()
    lookback = max(x.k for x in BARCELONA.lookups)
    want = {}
    for origin in range(60):
        if origin == 40:
            continue
        now = origin + 1
        # the newest of the last 9 hours, and the oldest of the last 3 and 6
        known = [h for h in range(60) if h != 40 and now - lookback < h + 0.5 <= now]
        s = [value(known[-1]), *(value(next(h for h in known if h + 0.5 > now - k)) for k in (3, 6))] if known else None
        if not any(now - 3 < h + 0.5 <= now for h in known):
            continue
        for step in range(1, BARCELONA.unrolled_steps + 1):
            p = sum(s) / 3
            s = [int(p + 0.5), s[0], s[1]]
            at = origin + 3 * step
            if at < 60 and at != 40:
                want[origin, step] = (p, value(at))
    have = {((r.slot_ts - T0).total_seconds() / 3600, r.step): (r.prediction, r.actual) for r in got}
    assert have.keys() == want.keys() and len(have) > 200
    assert all(abs(have[k][0] - want[k][0]) < 1e-9 and have[k][1] == want[k][1] for k in want)
    m = {r.step: r for r in horizon_metrics(spark.createDataFrame(got)).collect()}
    first = [p - a for (_, step), (p, a) in want.items() if step == 1]
    assert m[1].rows == len(first) and abs(m[1].bias - sum(first) / len(first)) < 1e-9
    assert backtest(spark.createDataFrame([], HIST), RunParams()).count() == 0
