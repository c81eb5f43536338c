"""Per-city MLlib pipelines - split, fit, evaluate, save, load.

Training is distributed by MLlib (tree nodes are found from per-partition
histograms); the split is a hash of the row, so it is stable across runs
and layouts and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockcast.config import CityRule
from dockcast.operators.metrics import accuracy, regression_metrics


# equal training rows are taken together where that leaves a row in so many, and the
# trees of a forest that are then fitted at once
GROUPING_PAYS, TREES_AT_ONCE = 8, 8


def build_pipeline(rule: CityRule, seed: int = 42, with_indexers: bool = False) -> Pipeline:
    """M1 + M2/M3 (+ M4): assembler and tree for one city.

    The assembler skips rows with a null feature while training; scoring
    only ever sees rows whose features are all set.
    """
    stages = []
    if with_indexers:
        # M4: fitted, as in the reference, but not part of the feature vector
        stages.append(
            StringIndexer(
                inputCols=["name", "weekday"], outputCols=["name-index", "weekday-index"], handleInvalid="keep"
            )
        )
    stages.append(VectorAssembler(inputCols=list(rule.features), outputCol="features", handleInvalid="skip"))
    if rule.task == "regression":
        stages.append(
            DecisionTreeRegressor(maxDepth=rule.tree_depth, labelCol=rule.label, featuresCol="features", seed=seed)
        )
    else:
        stages.append(
            RandomForestClassifier(
                numTrees=rule.num_trees,
                maxDepth=rule.tree_depth,
                bootstrap=rule.num_trees > 1,  # a single tree sees every row once
                featureSubsetStrategy="all",
                labelCol=rule.label,
                featuresCol="features",
                seed=seed,
            )
        )
    return Pipeline(stages=stages)


def hash_split(
    df: DataFrame, train_share: int = 8, buckets: int = 10, key: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """M6: stable 80/20 split on an integer ``key``, or on a hash of the whole row
    (no shuffle, no seed drift)."""
    side = _train_side(df, train_share, buckets, key)
    return df.where(side), df.where(~side)


def _train_side(df: DataFrame, train_share: int = 8, buckets: int = 10, key: Column | None = None) -> Column:
    h = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]) if key is None else key, F.lit(buckets))
    return h < train_share


def fit_pipeline(train: DataFrame, rule: CityRule, seed: int = 42, with_indexers: bool = False) -> PipelineModel:
    """M5: the fitted pipeline of one city.

    MLlib's forest takes every row for every tree at every level.  Where many rows are
    equal in features and label, the forest is fitted on one row for each such group
    (``fit_grouped_forest``); a table whose rows differ, and a single tree, go to MLlib
    as they are.
    """
    return _fit(train, equal_rows(train, rule, F.lit(True)), rule, seed, with_indexers)


def equal_rows(rows: DataFrame, rule: CityRule, train: Column) -> DataFrame | None:
    """The groups of rows that are equal in features, label and side (``__train``, null:
    neither), each with its number of rows ``__n``; written, so the rows are read once.
    None where the city has no forest of bootstraps or most training rows differ."""
    if not _bootstrapped(build_pipeline(rule).getStages()[-1]):
        return None
    keys = [*dict.fromkeys([*rule.features, rule.label])]
    side = rows.select(*keys, train.alias("__train"))
    groups = _written(side.groupBy(*keys, "__train").agg(F.count(F.lit(1)).alias("__n")), "groups")
    size = groups.where("__train").agg(F.count("__n").alias("groups"), F.sum("__n").alias("rows")).first()
    return groups if (size.rows or 0) >= GROUPING_PAYS * max(1, size.groups) else None


def _bootstrapped(stage) -> bool:
    return isinstance(stage, RandomForestClassifier) and stage.getBootstrap()


def _fit(train: DataFrame, groups: DataFrame | None, rule: CityRule, seed: int, with_indexers: bool) -> PipelineModel:
    pipeline = build_pipeline(rule, seed, with_indexers)
    if groups is None:
        return pipeline.fit(train)
    *first, forest = pipeline.getStages()
    groups = groups.where("__train").drop("__train")
    before = Pipeline(stages=first).fit(train)
    classes = int(groups.agg(F.max(rule.label)).first()[0]) + 1
    return PipelineModel([*before.stages, fit_grouped_forest(groups, before.stages[-1], forest, classes)])


def fit_grouped_forest(groups: DataFrame, assembler: VectorAssembler, forest: RandomForestClassifier, classes: int) -> RandomForestClassificationModel:
    """M3: ``forest`` on rows that each stand for ``__n`` equal ones.

    A bootstrap takes each row as often as a Poisson number of mean 1 says.  Over n equal
    rows these numbers add up to a Poisson number of mean n: it is drawn for each group
    and tree and is the group's weight when MLlib fits that tree.  The draws follow from
    the seed and the group, whatever the layout.
    """
    trees, label, features = forest.getNumTrees(), forest.getLabelCol(), forest.getFeaturesCol()
    keys = [c for c in groups.columns if c != "__n"]
    keyed = groups.select(F.xxhash64(F.lit(forest.getSeed()), *keys).alias("__key"), "*")
    weights = T.StructType([T.StructField(f"__w{t}", T.DoubleType()) for t in range(trees)])
    drawn = _written(keyed.mapInArrow(_bootstraps(trees), T.StructType([*groups.schema.fields, *weights.fields])), "bootstraps")
    known = {"ml_attr": {"type": "nominal", "num_vals": classes}}  # a tree may miss the last class
    rows = assembler.transform(drawn).withColumn(label, F.col(label).cast("double").alias(label, metadata=known))

    def fit(t: int):
        tree = DecisionTreeClassifier(
            featuresCol=features, labelCol=label, weightCol=f"__w{t}", maxDepth=forest.getMaxDepth(), seed=forest.getSeed()
        )
        return tree.fit(rows.select(features, label, f"__w{t}"))

    with ThreadPool(TREES_AT_ONCE) as pool:
        fitted = pool.map(inheritable_thread_target(groups.sparkSession)(fit), range(trees), chunksize=1)
    sc = groups.sparkSession.sparkContext
    array = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
    for t, tree in enumerate(fitted):
        array[t] = tree._java_obj
    joined = sc._jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(forest.uid, array, len(assembler.getInputCols()), classes)
    return forest._copyValues(RandomForestClassificationModel(joined))


def _bootstraps(trees: int):
    """Arrow batches without ``__key`` and with how often each tree takes a row's group."""

    def run(batches):
        for b in batches:
            drawn = np.empty((trees, b.num_rows))
            for i, (key, n) in enumerate(zip(b.column("__key").to_pylist(), b.column("__n").to_pylist())):
                drawn[:, i] = np.random.Generator(np.random.Philox(key=key % (1 << 64))).poisson(n, trees)
            kept = [c for c in b.schema.names if c != "__key"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, drawn)], names=[*kept, *(f"__w{t}" for t in range(trees))])

    return run


@dataclass
class Trained:
    city: str
    model: PipelineModel
    test_predictions: DataFrame
    metrics: DataFrame


def usable_rows(table: DataFrame, rule: CityRule) -> DataFrame:
    """Rows with a label and every feature set (what the assembler keeps)."""
    cond = F.col(rule.label).isNotNull()
    for f in rule.features:
        cond = cond & F.col(f).isNotNull()
    return table.where(cond)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back.

    Tree training passes over its input several times (metadata, split
    candidates, binned points): the shuffles that built the table run once,
    also after an executor loss.  It is dealt to ``spark.sql.shuffle.partitions``
    parts, so the passes use the cluster whatever the input files were.
    """
    return _written(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "training")


def _written(df: DataFrame, name: str) -> DataFrame:
    import uuid

    from dockcast.session import checkpoint_dir

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def train_city(
    table: DataFrame,
    rule: CityRule,
    seed: int = 42,
    with_indexers: bool = False,
    checkpoint: bool = True,
    split_key: Column | None = None,
) -> Trained:
    """M5-M8: fit on the 80 % side, score the 20 % side, report metrics.

    Where equal rows are taken together, fit and metrics read their groups alone: the
    rows are aggregated in one pass, and computed again by readers of
    ``test_predictions`` only.
    """
    rows = usable_rows(table, rule)
    groups = equal_rows(rows, rule, _train_side(rows, key=split_key))
    if checkpoint and groups is None:
        rows = materialise(rows)
    train, test = hash_split(rows, key=split_key)
    model = _fit(train, groups, rule, seed, with_indexers)
    scored = model.transform(test)
    if rule.task == "regression":
        m = regression_metrics(scored, rule.label, "prediction")
        metrics = m.select(
            F.lit(rule.city).alias("city"),
            F.explode(
                F.array(
                    *[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("rmse", "mae", "r2")]
                )
            ).alias("m"),
            "rows",
        ).select("city", "m.metric", "m.value", "rows")
    else:
        if groups is None:
            m = accuracy(scored, rule.label, "prediction")
        else:
            m = accuracy(model.transform(groups.where("NOT __train")), rule.label, "prediction", weight="__n")
        metrics = m.select(
            F.lit(rule.city).alias("city"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), "rows"
        )
    return Trained(rule.city, model, scored, metrics)


def mllib_metrics(trained: Trained, rule: CityRule) -> dict[str, float]:
    """Cross-check of M8 with the MLlib evaluators (driver-side scalars)."""
    if rule.task == "regression":
        ev = RegressionEvaluator(labelCol=rule.label, predictionCol="prediction")
        return {k: ev.setMetricName(k).evaluate(trained.test_predictions) for k in ("rmse", "mae", "r2")}
    ev = MulticlassClassificationEvaluator(labelCol=rule.label, predictionCol="prediction", metricName="accuracy")
    return {"accuracy": ev.evaluate(trained.test_predictions)}


def preview(scored: DataFrame, rule: CityRule, n: int = 10) -> DataFrame:
    """The first ``n`` scored rows, ordered so the preview is deterministic."""
    cols = ["prediction", rule.label, *[f for f in rule.features if f != rule.label]]
    return scored.select(*cols).orderBy(*[F.col(c).asc_nulls_first() for c in cols[1:]], "prediction").limit(n)


def save_model(model: PipelineModel, path: str) -> None:
    """Overwrite-save, as the reference does after every training run."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S9."""
    return PipelineModel.load(path)
