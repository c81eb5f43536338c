"""Raw history layouts, training CSVs, station files."""

import os
import tempfile

from dockcast.sources.files import read_stations, read_training_csv, split_quarantine
from dockcast.sources.history import normalise_history


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_stations_bom_crlf_and_quoted_commas(spark):
    d = tempfile.mkdtemp(prefix="stations-")
    _write(os.path.join(d, "all.csv"), b'id,station_id,name,City\n0,1,"GRAN VIA, 760",Barcelona\n1,2,"C/ X, 1",Barcelona\n')
    _write(os.path.join(d, "city.csv"), "﻿station_id,name,City\r\n0,Salitre,Malaga\r\n1,Cervantes,Malaga\r\n".encode())
    allst = {(r.city, r.station_id): r.name for r in read_stations(spark, os.path.join(d, "all.csv")).collect()}
    assert allst == {("Barcelona", 1): "GRAN VIA, 760", ("Barcelona", 2): "C/ X, 1"}
    per = read_stations(spark, os.path.join(d, "city.csv"), per_city=True).collect()
    assert [(r.city, r.station_id, r.name) for r in per] == [("Malaga", 0, "Salitre"), ("Malaga", 1, "Cervantes")]


def test_training_csv_bad_cell_is_quarantined(spark):
    d = tempfile.mkdtemp(prefix="train-")
    p = os.path.join(d, "bcn.csv")
    _write(p, b"available_bikes,id_station,hour,three_before,six_before,nine_before,day,blank,comp\n"
              b"5,1,10,4,3,2,1,0,1\n6,x,11,5,4,3,1,0,-1\n")
    clean, bad = split_quarantine(read_training_csv(spark, p, "Barcelona"))
    assert [r.available_bikes for r in clean.collect()] == [5]
    assert clean.count() == 1 and bad.count() == 1
    assert [r._corrupt_record for r in bad.collect()] == ["6,x,11,5,4,3,1,0,-1"]


def test_history_layouts_normalise(spark):
    bcn = spark.createDataFrame(
        [(1, "2024-01-01T10:00:00Z", "7", "12"), (2, "2024-01-01T10:30:00Z", "7", "n/a"), (3, "bad", "7", "3")],
        "_id long, update_date string, station_id string, num_bikes_available string",
    )
    snt = spark.createDataFrame(
        [(4, "2024-01-01T11:00:00Z", "3", "9")],
        "_id long, update_date string, `dc:identifier` string, `ayto:bicicletas_libres` string",
    )
    rows = sorted(normalise_history(bcn, snt).collect(), key=lambda r: r.reading_id)
    assert [(r.city, r.station_id, r.available) for r in rows] == [
        ("Barcelona", 7, 12), ("Barcelona", 7, None), ("Barcelona", 7, 3), ("Santander", 3, 9)
    ]
    assert rows[2].ts is None and str(rows[0].ts) == "2024-01-01 10:00:00"


def test_history_store_prunes_partitions_and_pushes_filters(spark):
    import datetime as dt

    from dockcast.sources.history import read_history, write_history
    from dockcast.sources.tables import events_history

    from conftest import SF_SMALL

    path = tempfile.mkdtemp(prefix="hist-") + "/h"
    hist = events_history(spark, SF_SMALL)
    write_history(hist, path)
    since, until = dt.datetime(2024, 1, 10, 6), dt.datetime(2024, 1, 11, 6)
    df = read_history(spark, path, since, until)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan
    want = hist.where((hist.ts > since) & (hist.ts <= until))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.select(*df.columns).collect()))


def test_history_documents_json_roundtrip(spark):
    from dockcast.sources.history import docs_from_history, normalise_history, read_history_docs
    from dockcast.sources.tables import events_history

    from conftest import SF_SMALL

    hist = events_history(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="docs-")
    for city in ("Barcelona", "Santander"):
        docs_from_history(hist, city).write.json(f"{d}/{city}")
    back = normalise_history(read_history_docs(spark, f"{d}/Barcelona", "Barcelona"),
                             read_history_docs(spark, f"{d}/Santander", "Santander"))
    want = hist.where("city IN ('Barcelona', 'Santander')")
    assert back.count() == want.count()
    # ISO text keeps whole seconds only
    assert back.join(want.select("reading_id", "available"), ["reading_id", "available"]).count() == want.count()
