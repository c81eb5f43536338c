"""M3, M7, F1: saved trees as expressions score exactly as the models they came from."""

import tempfile

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from dockcast.config import BARCELONA, CITY_RULES, DAY, MALAGA, SANTANDER, RunParams
from dockcast.operators import features as feat
from dockcast.operators.forecast import ModelPredictor
from dockcast.operators.trees import TreePredictor, node_table, with_prediction, with_shared_prediction
from dockcast.plans.predict import predict
from dockcast.plans.training import build_pipeline, load_model, save_model, usable_rows
from dockcast.sources.tables import events_history, events_requests, read_table

from conftest import SF_SMALL

SF = "/root/testdata/sf0.01"


def tables(spark):
    hist = events_history(spark, SF)
    return {
        "Barcelona": feat.lag_training_table(hist, BARCELONA, DAY),
        "Santander": feat.lag_training_table(hist, SANTANDER, DAY),
        "Malaga": feat.malaga_training_table(read_table(spark, SF, "lineitem")),
    }


@pytest.fixture(scope="module")
def models(spark):
    """city -> (table, path) of the reference's own trees: depth 10 and 8, 100 trees."""
    out = {}
    for city, t in tables(spark).items():
        rows = usable_rows(t, CITY_RULES[city]).cache()
        path = f"{tempfile.mkdtemp(prefix='trees-')}/{city}"
        save_model(build_pipeline(CITY_RULES[city]).fit(rows), path)
        out[city] = rows, path
    return out


@pytest.mark.parametrize("city", sorted(CITY_RULES))
def test_every_row_scores_as_the_model(spark, models, city):
    rows, path = models[city]
    table = node_table(spark, path)
    assert len(table.roots) == (100 if city == "Malaga" else 1) and table.depth <= CITY_RULES[city].tree_depth
    both = with_prediction(load_model(path).transform(rows).withColumnRenamed("prediction", "theirs"), table)
    assert both.where(~F.col("prediction").eqNullSafe(F.col("theirs"))).count() == 0
    assert both.select("prediction").distinct().count() > 3


def test_the_forest_votes_are_not_unanimous(spark, models):
    """What the equality above rests on: single trees disagree with the forest."""
    rows, path = models["Malaga"]
    few = rows.limit(2000)
    forest = node_table(spark, path)
    one = type(forest)(forest.inputs, forest.feature, forest.threshold, forest.left, forest.right, forest.value, forest.shares, forest.roots[:1], forest.depth)
    a = with_prediction(with_prediction(few, forest, "all_trees"), one, "first_tree")
    assert a.where("all_trees <> first_tree").count() > 0


def test_rows_with_equal_features_share_a_walk(spark, models):
    """the forest is walked for distinct features alone, nulls and repeated rows included."""
    rows, path = models["Malaga"]
    table = node_table(spark, path)
    few = rows.select(*table.inputs, "occupation").limit(500)
    few = few.union(few).union(few.limit(3).withColumn("hour", F.lit(None).cast("int")))
    shared = with_shared_prediction(few, table)
    assert shared.columns == [*few.columns, "prediction"] and shared.exceptAll(with_prediction(few, table)).count() == 0
    assert shared.count() == 1003
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert any(x.lstrip(" :+-").startswith("Aggregate") for x in plan.split("\n"))


def test_forecast_by_expressions_equals_the_models(spark, models):
    paths = {c: p for c, (_, p) in models.items()}
    args = events_requests(spark, SF_SMALL), events_history(spark, SF_SMALL)
    by = {}
    for name, p in (("trees", TreePredictor.load(spark, paths)), ("models", ModelPredictor({c: load_model(p) for c, p in paths.items()}))):
        got = predict(*args, p, RunParams(lag_unit=DAY)).collect()
        by[name] = sorted((r.request_id, r.predictionValue, r.status, r.steps) for r in got)
    assert by["trees"] == by["models"] and any(r[3] and r[3] > 1 for r in by["trees"])


def test_forecast_reads_the_tables_once(spark, models):
    """The requests (typed, without parsing in filters) and the history, whatever the cities."""
    paths = {c: p for c, (_, p) in models.items()}
    for p in (TreePredictor.load(spark, paths), ModelPredictor({c: load_model(x) for c, x in paths.items()})):
        plan = predict(events_requests(spark, SF_SMALL), events_history(spark, SF_SMALL), p, RunParams(lag_unit=DAY))._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("\n") if "FileScan parquet" in x]
        assert sum("events.parquet" in x for x in scans) <= 1  # the history; the requests were read when they were settled
        assert not any("RLIKE" in x or "get_json_object" in x for x in plan.split("\n") if "Filter" in x)


def test_a_city_without_a_model_has_no_prediction(spark, models):
    some = TreePredictor.load(spark, {"Malaga": models["Malaga"][1]})
    got = predict(events_requests(spark, SF_SMALL), events_history(spark, SF_SMALL), some, RunParams(lag_unit=DAY)).where("city <> 'Malaga'")
    assert {r.predictionValue for r in got.select("predictionValue").distinct().collect()} == {-1}


def saved(stages, df):
    path = tempfile.mkdtemp(prefix="tree-") + "/m"
    save_model(Pipeline(stages=stages).fit(df), path)
    return path


def test_single_leaves_nan_and_ties(spark):
    df = spark.createDataFrame([(float(i % 2), float(i), i % 2) for i in range(8)], "a double, b double, y int")
    flat = df.withColumn("y", F.lit(3.5))
    a = VectorAssembler(inputCols=["b", "a"], outputCol="features", handleInvalid="keep")
    path = saved([a, DecisionTreeRegressor(labelCol="y", seed=1)], flat)
    assert node_table(spark, path).depth == 0
    assert [r.prediction for r in with_prediction(df, node_table(spark, path)).collect()] == [3.5] * 8
    path = saved([a, DecisionTreeRegressor(labelCol="y", seed=1)], df)
    odd = spark.createDataFrame([(float("nan"), 1.0), (0.5, float("nan")), (float("inf"), 0.0)], "a double, b double")
    theirs = load_model(path).transform(odd).collect()
    assert [r.prediction for r in with_prediction(odd, node_table(spark, path)).collect()] == [r.prediction for r in theirs]
    # two trees that can't part the rows: the first of the most frequent classes wins
    same = df.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    path = saved([a, RandomForestClassifier(labelCol="y", numTrees=4, seed=3)], same)
    theirs = load_model(path).transform(same).collect()
    assert [r.prediction for r in with_prediction(same, node_table(spark, path)).collect()] == [r.prediction for r in theirs]


def test_categorical_splits_and_missing_assemblers_are_refused(spark):
    df = spark.createDataFrame([(c, float(len(c) * (i % 3))) for i in range(30) for c in ("x", "yy", "zzz")], "c string, y double")
    s = [StringIndexer(inputCol="c", outputCol="i"), VectorAssembler(inputCols=["i"], outputCol="features")]
    with pytest.raises(ValueError, match="categorical"):
        node_table(spark, saved([*s, DecisionTreeRegressor(labelCol="y")], df))
    with pytest.raises(ValueError, match="assembler"):
        node_table(spark, saved(s, df))
