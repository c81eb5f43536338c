"""Embedding near-duplicates: random-hyperplane sign hashing, exact check, components.

Vectors that are equal (same label, same direction bytes) form one class first.
Each class is hashed by ``BITS`` hyperplanes in each of ``TABLES`` tables; classes
of one label that agree in a whole table are compared by exact cosine in double
precision.  A pair is counted in the first table in which it meets, so no pair is
emitted or joined: a task returns link counts and a spanning forest.  Large
buckets are cut into chunks and every pair of chunks is a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockcast.llm.graph import components
from dockcast.llm.text import sorted_groups, written

THRESHOLD = 0.98
BITS = 16  # of a table; 0.936 ** 16 of the pairs at the threshold agree in one
TABLES = 16  # recall at the threshold: 1 - (1 - 0.936 ** 16) ** 16 > 0.998
CHUNK = 1024  # classes compared at once with as many others
SEED = 20240229


def planes(dims: int, bits: int = BITS, tables: int = TABLES) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, bits * tables))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest entry below one: exact, and
    no square of a very large or small entry overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -exponent[:, None])


def codes(x: np.ndarray, bits: int = BITS, tables: int = TABLES) -> np.ndarray:
    """One code for each row and table."""
    signs = (x @ planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2).astype(np.int32)


def forest(link: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric boolean matrix."""
    low = np.arange(len(link))
    while True:
        new = np.minimum(low, np.where(link, low[None, :], len(link)).min(axis=1, initial=len(link)))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, width)


def _vectors(col: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    return _matrix(col, len(col.flatten()) // len(col))


def _links(x: np.ndarray, code: np.ndarray, t: int, threshold: float) -> np.ndarray:
    """Pairs at the threshold that meet in table ``t`` and in none before it."""
    x = scaled(x)
    norm = np.sqrt((x * x).sum(axis=1))
    link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
    np.fill_diagonal(link, False)
    for s in range(t):
        link &= code[:, None, s] != code[None, :, s]
    return link


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, class id, vector) of every row; class and vector are null
    for rows that link with nothing."""
    v = F.col("vec")
    ok = (
        F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")
    )
    ok = F.coalesce(ok, F.lit(False))
    # -0.0 and 0.0 are one value
    return rows.select("vec_id", "label", F.when(ok, F.transform("vec", lambda x: x + F.lit(0.0))).alias("vec"))


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared only when their labels are equal and not null.  Vectors
    that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths.  Rows are vectors: repeated rows
    link with each other, and rows that share a vec_id fall into one component.
    Rows with a null vec_id have n_links, but no component.  Other columns are
    ignored.  No pair below ``threshold`` is linked; pairs at it are found with a
    probability over 0.99 (see TABLES).
    """
    rows = classes(vectors, id_col, vec_col, label_col)
    # the smallest id of a class stands for it; a class has one label and vector
    # as JSON, in which no label can be taken for a part of a vector
    name = F.sha2(F.to_json(F.struct(F.col("label").cast("string").alias("label"), "vec")), 256)
    rows = written(rows.withColumn("key", F.when(F.col("vec").isNotNull(), name)), "vectors")
    cls = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    # classes of null ids only still count links; their own number stands for them
    cls = cls.select("key", "rep", "size", F.col("label").cast("string").alias("label"), "vec", F.xxhash64("key").alias("node"))
    fields = ["key", "rep", "size", "label", "vec", "node"]
    cls = written(cls.mapInArrow(_with_codes(fields), f"{cls.schema.simpleString()[7:-1]}, codes array<int>"), "classes")

    # buckets by their keys alone: those with one member have nothing to compare, large ones are cut
    slot = F.posexplode("codes").alias("t", "code")
    keys = cls.select("node", "label", F.size("vec").cast("long").alias("dims"), slot)
    keys = keys.select("node", "label", "t", F.expr("shiftleft(dims, 40) + shiftleft(cast(t as long), 32) + code").alias("bucket"))
    sizes = keys.groupBy("bucket", "label").count().where("count > 1").select(
        F.col("bucket").alias("b"), F.col("label").alias("l"), F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")
    )
    cand = keys.join(sizes, (keys["bucket"] == sizes["b"]) & (keys["label"] == sizes["l"])).drop("b", "l")
    mine = F.pmod(F.xxhash64(F.lit(5), "node"), "chunks").cast("int")
    cand = cand.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cand = cand.withColumn("c1", F.least("mine", "other")).withColumn("c2", F.greatest("mine", "other"))
    cand = cand.withColumn("tile", F.xxhash64("bucket", "label", "c1", "c2")).select("tile", "node", "mine", "c1", "c2", "t")
    # vectors go to the tiles that are left
    cand = cand.join(cls.select("node", "size", "codes", "vec"), "node")

    found_schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(batches):
        for b, offsets in sorted_groups(batches, "tile"):
            node, size, mine, c1, c2, t = (b.column(c).to_numpy() for c in ("node", "size", "mine", "c1", "c2", "t"))
            code = _matrix(b.column("codes"), TABLES)
            nodes, links, roots = [], [], []
            for i, j in zip(offsets, offsets[1:]):
                link = _links(_vectors(b.column("vec").slice(i, j - i)), code[i:j], int(t[i]), threshold)
                if c1[i] != c2[i]:  # pairs inside a chunk belong to the chunk's own task
                    link &= mine[i:j, None] != mine[None, i:j]
                n = link @ size[i:j]
                hit = n > 0
                if hit.any():
                    nodes.append(node[i:j][hit])
                    links.append(n[hit])
                    roots.append(node[i:j][forest(link)][hit])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, links, roots)], schema=found_schema)

    cand = cand.select("tile", "node", "size", "mine", "c1", "c2", "t", "codes", "vec")
    found = cand.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "node long, links long, root long")
    found = written(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    # rows that share an id, whatever their class, are one vector's rows
    member = rows.where("key is not null").select("vec_id", F.xxhash64("key").alias("node"))
    reps = cls.select("node", "rep")
    edges = (
        found.select("node", "root").distinct()
        .join(reps, "node").withColumnRenamed("rep", "a")
        .join(reps.select(F.col("node").alias("root"), F.col("rep").alias("b")), "root")
        .select("a", "b")
        .unionByName(member.join(reps, "node").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    )
    comp = components(edges).select(F.col("id").alias("vec_id"), F.col("component").alias("comp"))
    own = cls.select("key", "node", "size").join(counts, "node", "left")
    own = own.select("key", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    out = rows.select("vec_id", "key").join(own, "key", "left").join(comp, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _with_codes(fields: list[str]):
    """Classes with the codes of their vectors."""

    def run(batches):
        for b in batches:
            lengths = np.array([len(v) for v in b.column("vec")])
            for dims in np.unique(lengths):
                part = b.filter(pa.array(lengths == dims))
                x = scaled(_matrix(part.column("vec"), int(dims)))
                found = codes(x / np.linalg.norm(x, axis=1, keepdims=True))
                columns = [part.column(f) for f in fields] + [pa.array(list(found), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*fields, "codes"])

    return run
