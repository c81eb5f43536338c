"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Vectors lie on a grid of integers; the fit list is each distinct one once, stored as
blocks of rows.  With X the centred fit list, each step is one distributed pass that
multiplies a block by a direction (Xv) and the transposed block by the result (X'u),
and sums.  The left vectors u are never stored: each is X times a short combination
of the right ones, so a pass makes them again from the block, and a lost executor
costs one block's rerun.  New left vectors are orthogonalised against all earlier
ones twice, first by what the driver knows of X'u, then by measured products; right
ones twice on the driver.  Where a direction is exhausted (repeated variances, fewer
distinct vectors than dimensions) the next one starts anew from a random vector
orthogonal to all.  There are as many steps as dimensions, as fewer might miss one of
two equal variances.  The singular values and vectors of the small bidiagonal matrix
give the deviations and the components.

What reaches the driver in a pass is one number for each dimension and step, summed
on the executors first.

Null vectors and those with a null or non-finite entry are left out of everything.
Shorter vectors than the longest count as zero in the missing entries, an empty
one as well.  Entries beyond 2**45 grid steps count as that.  Repeated rows
get a row each and count once in the fit.  Components without variance have no rows;
so an empty table, or one whose vectors are all equal, gives none.  A deviation that
doesn't fit a long is null.  Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockcast.llm.text import written

BLOCK_ROWS = 1 << 15
LIMIT = 1 << 45  # grid steps
NOTHING = 1e-9  # of the whole deviation: a direction without any
SUM_DDL = "slot int, value double"


def on_grid(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """id and x = floor(scale * entry) of the finite vectors, all of one length."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~odd)
    x = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))))
    low, high = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(high) - F.size("v")))
    return rows.select("id", x.cast("array<long>").alias("x"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _pack(batches):
    schema = pa.schema([("n", pa.int64()), ("bytes", pa.int32()), ("x", pa.binary())])
    for b in batches:
        for i in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(i, BLOCK_ROWS)
            x = _matrix(part, "x")
            width = next(w for w in (1, 2, 4, 8) if not x.size or max(int(x.max()), -int(x.min()) - 1) < 1 << (8 * w - 1))
            row = (part.num_rows, width, x.astype(f"<i{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)


def fit_blocks(grid: DataFrame) -> DataFrame:
    """Each distinct x once, in blocks, in the shared folder."""
    return written(grid.select("x").distinct().mapInArrow(_pack, "n long, bytes int, x binary"), "whitening-fit")


def _blocks(batches):
    for b in batches:
        for n, width, x in zip(*(b.column(c).to_pylist() for c in ("n", "bytes", "x"))):
            yield np.frombuffer(x, f"<i{width}").reshape(n, -1).astype(np.int64)


class Fit:
    """The distributed centred fit list."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

        def add(batches):
            n, sums = 0, 0
            for x in _blocks(batches):
                n, sums = n + len(x), sums + x.sum(axis=0)
            if n:
                at, values = range(-1, len(sums)), [n, *sums.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([str(v) for v in values])], names=["slot", "value"])

        # sums of integers beyond a long stay exact as decimals
        rows = blocks.mapInArrow(add, "slot int, value string").groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        got = {r.slot: int(r.value) for r in rows}
        self.n = got.pop(-1, 0)
        self.sums = [got[i] for i in range(len(got))]
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums])

    def summed(self, product) -> np.ndarray:
        """Sum of ``product(centred block)``, a vector, over all blocks."""
        mean = self.mean

        def run(batches):
            total = None
            for x in _blocks(batches):
                part = product(x - mean)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["slot", "value"])

        rows = self.blocks.mapInArrow(run, SUM_DDL).groupBy("slot").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(rows))
        for r in rows:
            out[r.slot] = r.value
        return out


def _orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    if to:
        basis = np.array(to)
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
    return v


def bidiagonalise(fit: Fit, *, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """(V, B, whole): right vectors as columns, the small upper bidiagonal matrix with
    X V = U B, and the sum of squares of X."""
    dims = len(fit.sums)
    whole = float(fit.summed(lambda c: np.array([(c * c).sum()]))[0]) if dims else 0.0
    if not whole:
        return np.zeros((dims, 0)), np.zeros((0, 0)), 0.0
    rng = np.random.default_rng(seed)
    nothing = NOTHING * np.sqrt(whole)

    def fresh(v: list[np.ndarray]) -> np.ndarray:
        x = _orthogonal(rng.standard_normal(dims), v)
        return x / np.linalg.norm(x)

    right = [fresh([])]
    short: list[np.ndarray] = []  # u = X short
    back: list[np.ndarray] = []  # X'u
    steps: list[tuple[int | None, float, float]] = []  # for each v: its u, alpha, beta to the next v
    while True:
        v = right[-1]
        y = v.copy()
        for s, g in zip(short, back):
            y -= (g @ v) * s
        alpha, xu = 0.0, np.zeros(dims)
        for _ in range(3):
            made = np.array([*short, y]).T

            def product(c, made=made):
                u = c @ made
                return np.concatenate((u.T @ u[:, -1], c.T @ u[:, -1]))

            got = fit.summed(product)
            along, square, xu = got[: len(short)], got[len(short)], got[len(short) + 1 :]
            for a, s, g in zip(along, short, back):
                y, xu = y - a * s, xu - a * g
            alpha = np.sqrt(max(square - along @ along, 0.0))
            if alpha <= nothing or not len(along) or np.abs(along).max() <= 1e-8 * alpha:
                break
        beta, then = 0.0, None
        if alpha > nothing:
            steps.append((len(short), alpha, 0.0))
            short.append(y / alpha)
            back.append(xu / alpha)
            then = _orthogonal(back[-1] - alpha * v, right)
            beta = float(np.linalg.norm(then))
        else:
            steps.append((None, 0.0, 0.0))
        if len(right) == dims:
            break
        if beta > nothing:
            steps[-1] = (steps[-1][0], alpha, beta)
            right.append(then / beta)
        else:
            right.append(fresh(right))
    b = np.zeros((len(short), dims))
    for i, (row, alpha, beta) in enumerate(steps):
        if row is not None:
            b[row, i] = alpha
            if i + 1 < dims:
                b[row, i + 1] = beta
    return np.array(right).T, b, whole


def whiten(
    rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: float = 64.0
) -> DataFrame:
    """For each finite vector and component: vec_id, component (from 1, by falling
    variance), n (the fit list's length), deviation (sum over dimensions of
    (n x - S)**2, exact), whitened, explained (share of the whole variance) and
    identity_error (of the whitened fit list's covariance).

    Deviations from a mean don't depend on the grid's origin, so x counts from 0.
    """
    grid = on_grid(rows, id_col=id_col, vec_col=vec_col, scale=scale)
    fit = Fit(fit_blocks(grid))
    right, b, whole = bidiagonalise(fit)
    _, sigma, q = np.linalg.svd(b) if b.size else (None, np.zeros(0), np.zeros((0, 0)))
    top = min(components, int((sigma > 1e-6 * sigma[0]).sum()) if len(sigma) else 0)
    ddl = f"vec_id {grid.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not top:
        return rows.sparkSession.createDataFrame([], ddl)
    n, sums, mean = fit.n, fit.sums, fit.mean
    share = sigma[:top] ** 2 / whole
    turn = (right @ q[:top].T) * (np.sqrt(n) / sigma[:top])

    def moments(c):
        z = c @ turn
        return np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))

    got = fit.summed(moments)
    centre = got[:top] / n
    covariance = got[top:].reshape(top, top) / n - np.outer(centre, centre)
    error = float(np.abs(covariance - np.eye(top)).max())

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS // 8):
                part = b.slice(i, BLOCK_ROWS // 8)
                x = _matrix(part, "x")
                m = part.num_rows
                z = (x - mean) @ turn
                ids = part.column("id").take(pa.array(np.repeat(np.arange(m), top)))
                far = _deviation(x, n, sums)
                columns = [
                    ids, pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), m)), pa.array(np.full(m * top, n)),
                    pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(m), top))), pa.array(z.ravel()),
                    pa.array(np.tile(share, m)), pa.array(np.full(m * top, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ddl.split(", ")])

    return grid.mapInArrow(run, ddl)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)**2 for each row; null beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if len(sums) * most * most < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]
