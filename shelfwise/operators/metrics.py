"""Accuracy metrics as aggregate expressions; all are partial sums, so they cost one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.percentiles import percentiles


def finite(y: Column, p: Column) -> Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return ok(y) & ok(p)


def row_error(y: Column, p: Column) -> Column:
    """|p - y| over the mean of their sizes; 0 where both are 0."""
    half = (F.abs(y) + F.abs(p)) / 2
    return F.when(half == 0, 0.0).otherwise(F.abs(p - y) / half)


def smape(y: Column, p: Column) -> Column:
    """Aggregate: 100 x mean row error; 0.0 without rows."""
    return F.coalesce(F.avg(row_error(y, p)) * 100, F.lit(0.0))


def smape_floor(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y) / F.greatest((F.abs(y) + F.abs(p)) / 2, F.lit(1e-8))) * 100


def smape_clipped(y: Column, p: Column) -> Column:
    c = F.greatest(p, F.lit(0.01))
    return F.avg(F.abs(y - c) / ((F.abs(y) + F.abs(c)) / 2 + 1e-8)) * 100


def smape_double(y: Column, p: Column) -> Column:
    total = F.abs(y) + F.abs(p)
    return F.avg(F.when(total == 0, 0.0).otherwise(2 * F.abs(p - y) / total)) * 100


def regression(y: Column, p: Column) -> dict[str, Column]:
    e = p - y
    return {"mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "r2": 1 - F.sum(e * e) / (F.count(y) * F.var_pop(y)), "mape": F.avg(F.when(y != 0, F.abs(e / y))) * 100}


def with_quantile_bucket(df: DataFrame, column: str, n: int, of: DataFrame | None = None) -> DataFrame:
    """Bucket 1..n by linear percentile edges; half-open, the last closed. The edges are one row and are broadcast. They are
    those of ``of``, where the same values are cheaper to come by."""
    edges = percentiles(df if of is None else of, column, [i / n for i in range(1, n)], "edges")
    rank = F.size(F.filter("edges", lambda e: F.col(column) >= e)) + 1
    return df.join(F.broadcast(edges), F.lit(True)).withColumn("bucket", F.when(F.col(column).isNotNull(), rank)).drop("edges")
