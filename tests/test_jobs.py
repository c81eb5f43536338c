"""S8/S9 round trip through the job helpers: saved models score like fresh ones."""

import tempfile

from dockcast.config import DAY, RunParams
from dockcast.jobs import load_all, train_all, training_tables
from dockcast.operators.forecast import ModelPredictor
from dockcast.plans.predict import predict
from dockcast.sources.tables import events_history, events_requests

from conftest import SF_SMALL


def test_train_save_load_and_serve(spark):
    models = tempfile.mkdtemp(prefix="models-")
    metrics = train_all(spark, training_tables(spark, "/root/testdata/sf0.01", unit=DAY), models).collect()
    assert {r.city for r in metrics} == {"Barcelona", "Santander", "Malaga"}
    loaded = load_all(spark, models)
    assert set(loaded) == {"Barcelona", "Santander", "Malaga"}
    out = predict(events_requests(spark, SF_SMALL), events_history(spark, SF_SMALL), ModelPredictor(loaded),
                  RunParams(lag_unit=DAY)).collect()
    assert len(out) == 1000
    ok = [r for r in out if r.status == "ok"]
    assert ok and all(r.predictionValue >= 0 for r in ok)
    assert all(r.predictionValue % 10 == 0 for r in ok if r.city == "Malaga")
