"""A2-A5: evaluation metrics as grouped aggregates (one pass, any grouping).

The MLlib evaluators compute one number per DataFrame; these give the same
numbers per city / station / anything in one job, with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regression_metrics(df: DataFrame, label: Column | str, prediction: Column | str, by: list[str] = ()) -> DataFrame:
    """A2 rmse, A3 mae, A4 r2 (1 - SSE/SST; null for constant labels), plus row count."""
    y, p = _c(label).cast("double"), _c(prediction).cast("double")
    err = p - y
    n = F.count(F.lit(1))
    sse = F.sum(err * err)
    sst = F.var_pop(y) * n  # around the mean: sums of squares would cancel
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(
        n.alias("rows"),
        F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when(F.max(y) > F.min(y), F.lit(1.0) - sse / sst).alias("r2"),
    )
    return out


def accuracy(
    df: DataFrame, label: Column | str, prediction: Column | str, by: list[str] = (), weight: Column | str | None = None
) -> DataFrame:
    """A5: share of rows whose predicted class equals the label; a row stands for
    ``weight`` equal ones."""
    hit = F.when(_c(prediction).cast("double") == _c(label).cast("double"), 1.0).otherwise(0.0)
    g = df.groupBy(*by) if by else df.groupBy()
    if weight is None:
        return g.agg(F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"))
    n = F.sum(_c(weight))
    return g.agg(F.coalesce(n, F.lit(0)).cast("long").alias("rows"), F.try_divide(F.sum(hit * _c(weight)), n).alias("accuracy"))
