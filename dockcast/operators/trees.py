"""M3, M7, F1: saved trees and forests as column expressions.

A fitted tree is a table of nodes.  Here the node tables of a saved pipeline become
constant arrays, and scoring a row is a walk through them: as many steps as the
deepest tree, each taking the left or the right child; a leaf leads to itself.  A
forest walks from each root, adds up the class shares of the leaves in the order of
the trees and takes the first class with the most, as its own vote does.  The result
is one JVM expression whose size doesn't grow with the number of steps or trees, so a
recursive forecast stays a chain of projections, all cities are scored in one pass and
nothing is split or looked up again for a city.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dockcast.config import CityRule


@dataclass(frozen=True)
class NodeTable:
    """Nodes of all trees of a model, numbered in one list."""

    inputs: tuple[str, ...]  # names of the features
    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]  # prediction of a leaf
    shares: list[list[float] | None] | None  # class shares of a leaf of a voting forest
    roots: list[int]
    depth: int

    def sql(self, inputs: dict[str, str]) -> str:
        """The prediction as SQL text over ``inputs`` (feature name -> SQL)."""
        x = "array(" + ", ".join(f"CAST({inputs[f]} AS DOUBLE)" for f in self.inputs) + ")"
        goes_left = f"{x}[{_array(self.feature, 'int')}[n]] <= {_array(self.threshold, 'double')}[n]"
        child = f"IF({goes_left}, {_array(self.left, 'int')}[n], {_array(self.right, 'int')}[n])"

        def leaf(root: str) -> str:
            return f"aggregate(sequence(1, {max(self.depth, 1)}), {root}, (n, i) -> {child})"

        if self.shares is None:
            return f"{_array(self.value, 'double')}[{leaf(str(self.roots[0]))}]"
        leaves = f"transform({_array(self.roots, 'int')}, r -> {leaf('r')})"
        none = _array([0.0] * len(next(s for s in self.shares if s)), "double")
        votes = f"aggregate({leaves}, {none}, (v, n) -> zip_with(v, {_array(self.shares, 'array<double>')}[n], (a, b) -> a + b))"
        return f"transform(array({votes}), v -> CAST(array_position(v, array_max(v)) - 1 AS DOUBLE))[0]"


def _array(values: list, kind: str) -> str:
    """A constant array: its text is parsed once, when the plan is optimised."""
    return f"from_json('{json.dumps(values)}', 'array<{kind}>')"


def node_table(spark: SparkSession, path: str) -> NodeTable:
    """The node table of the pipeline saved in ``path``.

    The pipeline is an assembler, further stages that don't touch its features, and a
    tree or forest as its last stage, with continuous features only.
    """
    model = PipelineModel.load(path)
    tree = model.stages[-1]
    wanted = tree.getFeaturesCol() if hasattr(tree, "getFeaturesCol") else None
    assembler = next((s for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == wanted), None)
    if assembler is None:
        raise ValueError(f"no assembler and tree in {path}")
    digits = len(str(len(model.stages)))
    folder = f"{path.rstrip('/')}/stages/{len(model.stages) - 1:0{digits}d}_{tree.uid}"
    data = spark.read.parquet(f"{folder}/data")
    forest = "treeID" in data.columns
    rows = data.select("treeID", "nodeData.*") if forest else data.select(F.lit(0).alias("treeID"), "*")
    votes = hasattr(tree, "numClasses") and forest
    return _numbered(rows, tuple(assembler.getInputCols()), votes)


def _numbered(rows: DataFrame, inputs: tuple[str, ...], votes: bool) -> NodeTable:
    """A model's size bounds its nodes: 2 ** (depth + 1) for each tree."""
    nodes = sorted(rows.collect(), key=lambda r: (r.treeID, r.id))
    number = {(r.treeID, r.id): i for i, r in enumerate(nodes)}
    feature, threshold, left, right, value, shares = [], [], [], [], [], []
    for i, r in enumerate(nodes):
        if r.leftChild < 0:
            split = (0, 0.0, i, i)
        else:
            if r.split.numCategories >= 0:
                raise ValueError("categorical splits have no threshold")
            split = (r.split.featureIndex, r.split.leftCategoriesOrThreshold[0], number[r.treeID, r.leftChild], number[r.treeID, r.rightChild])
        for column, v in zip((feature, threshold, left, right), split):
            column.append(v)
        value.append(r.prediction)
        shares.append(_shares(r) if votes and r.leftChild < 0 else None)
    roots = [number[t, 0] for t in sorted({r.treeID for r in nodes})]
    return NodeTable(inputs, feature, threshold, left, right, value, shares if votes else None, roots, _depth(roots, left, right))


def _shares(leaf: Row) -> list[float]:
    total = sum(leaf.impurityStats)
    return [c / total if total else 0.0 for c in leaf.impurityStats]


def _depth(roots: list[int], left: list[int], right: list[int]) -> int:
    level, depth = roots, 0
    while level := [c for n in level if left[n] != n for c in (left[n], right[n])]:
        depth += 1
    return depth


class TreePredictor:
    """An expression predictor (see ``forecast``) over the saved trees of each city."""

    def __init__(self, tables: dict[str, NodeTable]):
        self.tables = tables

    @classmethod
    def load(cls, spark: SparkSession, paths: dict[str, str]) -> TreePredictor:
        return cls({city: node_table(spark, path) for city, path in paths.items()})

    def sql(self, rule: CityRule) -> str:
        """Over the lag state; null for a city without a model."""
        table = self.tables.get(rule.city)
        return "CAST(NULL AS DOUBLE)" if table is None else table.sql(state_inputs(rule))


def state_inputs(rule: CityRule) -> dict[str, str]:
    """SQL of each model input over the columns of the forecast's state."""
    out = {f: f"coalesce(s{slot}, 0)" for slot, f in rule.slot_features.items()}
    station = "coalesce(station_id, 0)"
    return out | {"id_station": station, "name": station, "hour": "coalesce(_req_hour, 0)", "weekday": "coalesce(_req_weekday, 0)"}


def with_prediction(df: DataFrame, table: NodeTable, out_col: str = "prediction") -> DataFrame:
    """M7: ``df`` with the model's prediction from its feature columns."""
    return df.withColumn(out_col, F.expr(table.sql({f: f"`{f}`" for f in table.inputs})))


def with_shared_prediction(df: DataFrame, table: NodeTable, out_col: str = "prediction") -> DataFrame:
    """M7: as ``with_prediction``; rows with equal features share one walk, which pays
    for a forest, whose walk takes as many steps as its trees are deep in all.  A null
    feature meets itself."""
    walked = with_prediction(df.select(*table.inputs).distinct(), table, "__shared")
    walked = walked.select(*[F.col(f).alias(f"__{i}") for i, f in enumerate(table.inputs)], F.col("__shared").alias(out_col))
    same = [F.col(f).eqNullSafe(F.col(f"__{i}")) for i, f in enumerate(table.inputs)]
    return df.join(walked, same).drop(*[f"__{i}" for i in range(len(table.inputs))])
