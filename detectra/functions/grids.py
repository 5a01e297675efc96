"""Evaluation grids with explicit ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linspace(i: Column, lo: Column, hi: Column, n: int) -> Column:
    """Point i of n evenly spaced points; the last is exactly hi."""
    if n == 1:
        return lo.cast("double")
    return F.when(i == n - 1, hi.cast("double")).otherwise(lo + i * ((hi - lo) / F.lit(float(n - 1))))


def line(spark: SparkSession, name: str, lo: float, hi: float, n: int = 100, start: int = 0) -> DataFrame:
    """(grid_id, name) of n points."""
    ids = spark.range(start, start + n, numPartitions=1)
    return ids.select(F.col("id").alias("grid_id"), linspace(F.col("id") - start, F.lit(float(lo)), F.lit(float(hi)), n).alias(name))


def mesh(spark: SparkSession, names: tuple[str, str], los: tuple[float, float], his: tuple[float, float], n: int = 30) -> DataFrame:
    """(grid_id, a, b) of n * n points; the first variable is the slowest."""
    ids = spark.range(0, n * n, numPartitions=1)
    a, b = F.floor(F.col("id") / n), F.col("id") % n
    return ids.select(
        F.col("id").alias("grid_id"),
        linspace(a, F.lit(float(los[0])), F.lit(float(his[0])), n).alias(names[0]),
        linspace(b, F.lit(float(los[1])), F.lit(float(his[1])), n).alias(names[1]),
    )


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear lookup in sorted arrays, constant beyond both ends.

    The bracket is the last knot at or below x.
    """
    n = F.size(xs)
    k = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(xs, lambda v: v <= x))))
    x0, x1, y0, y1 = F.element_at(xs, k), F.element_at(xs, k + 1), F.element_at(ys, k), F.element_at(ys, k + 1)
    inside = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(x <= F.element_at(xs, 1), F.element_at(ys, 1)).when(x >= F.element_at(xs, n), F.element_at(ys, n)).otherwise(inside)
