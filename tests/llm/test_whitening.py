"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockcast.llm import queries as Q
from dockcast.llm import whitening

SF = "/root/testdata/sf0.001"


def check(df, ids, vectors, components=16):
    """Every column from the contract's formulas; repeated variances only by their span."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    top = min(components, int((e > 1e-9 * e[0]).sum()))
    rows = df.collect()
    assert len(rows) == len(ids) * top
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    deviation = ((n * x - s) ** 2).sum(axis=1)
    z = np.empty((len(ids), top))
    for i, d, k in zip(ids, deviation, range(len(ids))):
        mine = [got[i][j + 1] for j in range(top)]
        assert {(r.n, r.deviation) for r in mine} == {(n, d)}
        assert np.allclose([r.explained for r in mine], e[:top] / np.trace(v), rtol=1e-9)
        assert all(0 <= r.identity_error <= 1e-9 for r in mine)
        z[k] = [r.whitened for r in mine]
    # the component of each column from the rows themselves: least squares on the centred vectors
    part = np.linalg.lstsq((x - s / n), z * np.sqrt(e[:top]), rcond=1e-10)[0]
    assert np.allclose(np.linalg.norm(part, axis=0), 1, atol=1e-7)
    assert np.allclose(v @ part, part * e[:top], atol=1e-7 * e[0])
    single = [j for j in range(top) if all(abs(e[j] - e[k]) > 1e-6 * e[0] for k in range(len(e)) if k != j)]
    assert np.allclose(np.abs((part * w[:, :top]).sum(axis=0))[single], 1, atol=1e-7)
    return single


def test_query_on_the_whole_table(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    assert len(check(Q.op13_whitening(spark, SF), raw["vec_id"].tolist(), raw["embedding"].tolist())) == 16


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit("x") for c in ("id", "v", "x", "n", "slot", "value", "component")})


def test_equal_variances_and_missing_dimensions(spark):
    # the corners of a cross: three equal variances, a fourth dimension that never varies
    corners = [(s * (j == 0), s * (j == 1), s * (j == 2), 5.0) for j in range(3) for s in (-1.0, 1.0)]
    rows = [(i, list(v)) for i, v in enumerate(corners * 3)]
    check(whitening.whiten(table(spark, rows)), [i for i, _ in rows], [v for _, v in rows])


def test_odd_rows(spark):
    good = [(i, [float(i % 7), float(i * i % 11), float(-i % 5)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0])]
    short = [(200, []), (201, [3.0]), (202, [1.0, 2.0])]
    same = [(300, [2.0, 2.0, 2.0])] + [(301 + i, [2.0, 2.0, 2.0]) for i in range(200)]
    rows = good + short + same
    full = [(i, (v + [0.0] * 3)[:3]) for i, v in rows]
    check(whitening.whiten(table(spark, rows + odd)), [i for i, _ in full], [v for _, v in full])
    assert whitening.whiten(table(spark, rows), components=2).where("component > 2").count() == 0
    huge = whitening.whiten(table(spark, rows + [(400, [1e300, -1e300, 1.0])])).collect()
    assert {r.vec_id for r in huge} == {i for i, _ in rows} | {400}
    assert all(r.deviation is None for r in huge if r.vec_id == 400) and all(np.isfinite(r.whitened) for r in huge)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])], [(1, [0.0]), (2, [0.001])]])
def test_nothing_to_fit(spark, rows):
    df = whitening.whiten(table(spark, rows))
    assert df.count() == 0 and df.columns[:2] == ["vec_id", "component"]
