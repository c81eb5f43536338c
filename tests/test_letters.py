"""Texts and rows that can't be used, and the training job from CSV files."""

import csv
import tempfile

from pyspark.sql import functions as F

from dockcast import jobs
from dockcast.config import CITY_RULES, DAY, RunParams
from dockcast.operators.requests import REJECT_REASONS, extract_requests, validate_requests, with_reason, write_letters
from dockcast.plans.models import ModelStore
from dockcast.schemas import TRAIN_SCHEMAS
from dockcast.sources.files import TRAINING_FILES
from dockcast.sources.notifications import flatten_entities
from dockcast.sources.tables import events_history
from dockcast.streaming.commits import Outbox
from dockcast.streaming.stream import make_batch_scorer

from test_streaming import AS_OF

from conftest import SF_SMALL


def note(**attrs):
    import json

    base = dict(idStation="1", weekday="1", hour="5", month="2", city="Barcelona", predictionId="p", socketId="s") | attrs
    entity = {"id": "e", "type": "ReqPrediction"} | {k: {"type": "Property", "value": v} for k, v in base.items() if v is not None}
    return json.dumps({"id": "n", "type": "Notification", "data": [entity]})


CASES = [
    (note(), None, None),
    (note(hour=7, idStation=519), None, None),  # numbers count as text
    ('{"id": "n", "data": [', "broken_json", None),
    ("no json", "broken_json", None),
    ("", "broken_json", None),
    ('{"id": "n", "data": []}', "no_entities", None),
    ('{"id": "n"}', "no_entities", None),
    (note(city=None), "unknown_city", None),
    (note(city="Atlantis", hour="99"), "unknown_city", None),
    (note(hour="x", month=None), "malformed", "hour,month"),
    (note(socketId=None, idStation="1.5"), "malformed", "idStation,socketId"),
    (note(idStation="520", weekday="0"), "invalid_request", "idStation,weekday"),
    (note(city="Malaga", idStation="0", hour="24"), "invalid_request", "hour"),
]


def judged(spark, texts):
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    return with_reason(validate_requests(extract_requests(flatten_entities(raw), requested_at=F.lit("2024-01-01 00:00:00"))))


def test_reasons_and_details(spark):
    got = {r.raw: (r.reason, r.detail) for r in judged(spark, [t for t, _, _ in CASES]).collect()}
    assert got == {t: (reason, detail) for t, reason, detail in CASES}


def test_letters_are_routed_and_counted_in_one_pass(spark):
    path = tempfile.mkdtemp(prefix="letters-") + "/out"
    counts = write_letters(judged(spark, [t for t, _, _ in CASES] * 3), path)
    assert counts == {"good": 6, "broken_json": 9, "no_entities": 6, "unknown_city": 6, "malformed": 6, "invalid_request": 6}
    assert set(counts) == {"good", *REJECT_REASONS}
    assert spark.read.parquet(f"{path}/letter=good").count() == 6 and spark.read.parquet(f"{path}/letter=bad").count() == 33


def test_service_keeps_what_it_cannot_answer(spark):
    root = tempfile.mkdtemp(prefix="rejected-")
    raw = spark.createDataFrame([(t,) for t, _, _ in CASES], "value string")
    score = make_batch_scorer(lambda since, until: events_history(spark, SF_SMALL), f"{root}/outbox", params=RunParams(lag_unit=DAY), as_of=lambda b: AS_OF, rejected_dir=f"{root}/rejected")
    for _ in range(2):
        score(raw, 0)
    bad = Outbox(spark, f"{root}/rejected").read().collect()
    assert sorted((r.raw, r.reason) for r in bad) == sorted((t, reason) for t, reason, _ in CASES if reason)
    assert Outbox(spark, f"{root}/outbox").read().count() == len(CASES)


def test_training_from_csv_files_sets_bad_rows_aside(spark):
    root = tempfile.mkdtemp(prefix="csv-train-")
    tables = jobs.training_tables(spark, "/root/testdata/sf0.01", unit=DAY)
    bad = {"Barcelona": ["x,y", "1,2,3,4,5,6,7,8,z"], "Santander": [",,,,,,,,,,"], "Malaga": ['"unclosed']}
    good = {}
    for city, table in tables.items():
        columns = [f.name for f in TRAIN_SCHEMAS[city].fields]
        rows = [[r[c] if c in r else None for c in columns] for r in (x.asDict() for x in table.limit(3000).collect())]
        good[city] = len(rows)
        with open(f"{root}/{TRAINING_FILES[city]}", "w", newline="", encoding="utf-8-sig" if city == "Santander" else "utf-8") as f:
            w = csv.writer(f, lineterminator="\r\n" if city == "Santander" else "\n")
            w.writerow(columns)
            w.writerows(rows)
            f.write("\n".join(bad[city]) + "\n\n")
    read, counts = jobs.csv_tables(spark, root, f"{root}/rejected")
    assert counts == {c: {"good": good[c], "bad_row": len(bad[c])} for c in bad}
    kept = [r.raw for r in spark.read.parquet(f"{root}/rejected/*/letter=bad").collect()]
    assert sorted(kept) == sorted(x for lines in bad.values() for x in lines)
    previews = {}
    metrics = jobs.train_all(spark, read, f"{root}/models", previews).collect()
    assert {r.city for r in metrics} == set(CITY_RULES) and all(r.rows > 0 for r in metrics)
    assert set(previews) == set(CITY_RULES) and all(0 < p.count() <= 10 and p.columns[0] == "prediction" for p in previews.values())
    assert {c: ModelStore(spark, f"{root}/models").versions(c) for c in CITY_RULES} == {c: [1] for c in CITY_RULES}
