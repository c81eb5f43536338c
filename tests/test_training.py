"""Fit, evaluate (SQL metrics = MLlib evaluators), save and load."""

import math
import tempfile
from dataclasses import replace

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from dockcast.config import BARCELONA, MALAGA
from dockcast.operators import features as feat
from dockcast.plans import training
from dockcast.plans.training import build_pipeline, load_model, mllib_metrics, save_model, train_city
from dockcast.sources.tables import events_history, read_table

from conftest import SF_SMALL


def test_regression_metrics_equal_mllib_and_roundtrip(spark):
    hist = events_history(spark, "/root/testdata/sf0.01")
    table = feat.lag_training_table(hist, BARCELONA, 86400)
    tr = train_city(table, BARCELONA)
    ours = {r.metric: r.value for r in tr.metrics.collect()}
    ref = mllib_metrics(tr, BARCELONA)
    for k in ("rmse", "mae", "r2"):
        assert math.isclose(ours[k], ref[k], rel_tol=1e-9, abs_tol=1e-9), k
    path = tempfile.mkdtemp(prefix="model-") + "/barcelona"
    save_model(tr.model, path)
    save_model(tr.model, path)  # overwrite, as every training run does
    again = load_model(path).transform(tr.test_predictions.drop("features", "prediction"))
    a = sorted(r.prediction for r in tr.test_predictions.collect())
    b = sorted(r.prediction for r in again.collect())
    assert a == b


def test_classification_accuracy_equals_mllib(spark):
    table = feat.malaga_training_table(read_table(spark, SF_SMALL, "lineitem"))
    tr = train_city(table, MALAGA)
    ours = {r.metric: r.value for r in tr.metrics.collect()}
    assert math.isclose(ours["accuracy"], mllib_metrics(tr, MALAGA)["accuracy"], rel_tol=1e-12)


def test_indexers_are_fitted_but_not_features(spark):
    from dockcast.plans.training import build_pipeline

    p = build_pipeline(MALAGA, with_indexers=True)
    assert [type(s).__name__ for s in p.getStages()] == ["StringIndexer", "VectorAssembler", "RandomForestClassifier"]
    assert p.getStages()[1].getInputCols() == ["name", "weekday", "hour"]


def equal_rows(spark, n=6000):
    """Rows of 30 kinds, the label of each row not what its features say alone."""
    return spark.range(n, numPartitions=4).select(
        (F.col("id") % 5).cast("int").alias("name"), (F.col("id") % 3).cast("int").alias("weekday"),
        (F.when(F.floor(F.col("id") / 15) % 10 < 7, (F.col("id") % 5 + F.col("id") % 3) % 4).otherwise(F.floor(F.col("id") / 15) % 2)).cast("int").alias("occupation"),
    )


FOREST = replace(MALAGA, features=("name", "weekday"), tree_depth=3, num_trees=12)


def test_a_forest_takes_equal_rows_together(spark, monkeypatch):
    """MLlib's forest would take each of the 6000 rows for each tree at each level."""
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *_: (_ for _ in ()).throw(AssertionError("every row for every tree")))
    rows = equal_rows(spark)
    trained = train_city(rows, FOREST, split_key=F.lit(0))
    path = tempfile.mkdtemp(prefix="forest-") + "/m"
    save_model(trained.model, path)
    forest = load_model(path).stages[-1]
    assert forest.getNumTrees == 12 and forest.numClasses == 4 and forest.numFeatures == 2 and forest.getFeaturesCol() == "features"
    common = rows.groupBy("name", "weekday", "occupation").count().groupBy("name", "weekday").agg(F.max_by("occupation", "count").alias("common"))
    deep = train_city(rows, replace(FOREST, tree_depth=8), split_key=F.lit(0)).model.transform(common)
    assert deep.where("prediction <> common").count() == 0 and deep.count() == 15


def test_a_tree_of_groups_is_the_tree_of_their_rows(spark):
    """a group's weight counts as so many rows of it."""
    rows = equal_rows(spark)
    groups = rows.groupBy("name", "weekday", "occupation").agg(F.count(F.lit(1)).alias("__n"))
    assembler, forest = build_pipeline(FOREST).getStages()
    model = training.fit_grouped_forest(groups, assembler, forest, 4)
    keyed = groups.select(F.xxhash64(F.lit(forest.getSeed()), "name", "weekday", "occupation").alias("__key"), "*")
    drawn = keyed.mapInArrow(training._bootstraps(12), "name int, weekday int, occupation int, __n long, " + ", ".join(f"__w{t} double" for t in range(12)))
    weights = drawn.toPandas()
    other = keyed.repartition(3, "occupation").mapInArrow(training._bootstraps(12), drawn.schema).toPandas()  # another layout
    assert sorted(weights.itertuples(index=False)) == sorted(other.itertuples(index=False))
    ratio = weights.filter(like="__w").sum() / weights["__n"].sum()
    assert (abs(ratio - 1) < 0.08).all() and weights.filter(like="__w").nunique(axis=1).min() > 3
    for t in (0, 7):
        whole = assembler.transform(drawn.select("*", F.explode(F.sequence(F.lit(1), F.col(f"__w{t}").cast("int")))).where(f"__w{t} > 0"))
        alone = DecisionTreeClassifier(labelCol="occupation", maxDepth=3, seed=forest.getSeed()).fit(whole)
        assert model.trees[t].toDebugString.split("\n")[1:] == alone.toDebugString.split("\n")[1:]
    assert len({tree.toDebugString.split("\n", 1)[1] for tree in model.trees}) > 1


def test_rows_that_differ_go_to_mllib_as_they_are(spark):
    rows = equal_rows(spark, 60)
    ours, theirs = (m.stages[-1].toDebugString.split("\n")[1:] for m in (training.fit_pipeline(rows, FOREST), build_pipeline(FOREST).fit(rows)))
    assert ours == theirs


def test_a_forest_is_measured_on_groups_of_equal_rows(spark, monkeypatch):
    """all columns of all rows were dealt and written, and each held-out row walked through each tree."""
    monkeypatch.setattr(training, "materialise", lambda _: (_ for _ in ()).throw(AssertionError("rows written")))
    written = []
    monkeypatch.setattr(training, "_written", lambda df, name, do=training._written: written.append(do(df, name)) or written[-1])
    rows = equal_rows(spark).withColumn("other", F.monotonically_increasing_id())
    for key in (None, F.when(F.col("other") % 7 > 0, F.col("other"))):  # a null key: on neither side
        trained = train_city(rows, FOREST, split_key=key)
        got = trained.metrics.collect()
        assert got[0].rows == trained.test_predictions.count() and 900 < got[0].rows < 1500
        assert math.isclose(got[0].value, mllib_metrics(trained, FOREST)["accuracy"], rel_tol=1e-12)
        assert "other" in trained.test_predictions.columns
    assert all(df.count() <= 200 for df in written)
    nothing = train_city(rows, FOREST, split_key=F.lit(0)).metrics.collect()
    assert [tuple(r) for r in nothing] == [("Malaga", "accuracy", None, 0)]
