"""Connected components by alternating large-star and small-star steps.

Every step is a join of the edges with one minimum per node, so a node with a
third of all edges is pre-aggregated before the shuffle and its join side can be
split.  The edge count never grows; the number of rounds is logarithmic on the
graphs at hand.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockcast.llm.text import written


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(arcs: DataFrame, keep_larger: bool) -> DataFrame:
    """Link the neighbours of each node (those above it, or all) with its minimum."""
    low = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = arcs.join(low, "a")
    if keep_larger:
        j = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # the node itself goes to the minimum too
        j = j.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return j.where("a <> b").distinct()


def _settled(e: DataFrame) -> bool:
    """Every node points once and no node that points is pointed to: stars."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        e.select(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    node = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return node.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) -> (id, component): smallest id reachable.

    Only nodes above their component's smallest id have a row.  Null ends and self loops are ignored;
    repeated edges count once.  No edges: an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    # larger end first: (a, b) with a > b
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-0")
    for i in range(max_rounds):
        if _settled(e):
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        large = _star(_both(e), keep_larger=True)
        # a > b already holds, so small-star works on the arcs as they are
        e = written(_star(large, keep_larger=False), f"cc-{i + 1}")
    raise RuntimeError(f"no convergence after {max_rounds} rounds")


def with_components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``ids`` (id, ...) with ``component``: its own id where it has no edge."""
    return ids.join(components(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))
