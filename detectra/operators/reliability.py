"""Confidence bounds over replicates, reliability points and tables, convergence traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (50, 90, 95, 99)
TARGETS = (0.5, 0.9, 0.95, 0.99)


def confidence_bounds(curves: DataFrame, levels: Sequence[int] = LEVELS, value: str = "pod") -> DataFrame:
    """(grid_id, level, ci_lower, ci_upper): two-sided percentiles over replicates."""
    cuts = sorted({p for c in levels for p in ((100 - c) / 200, (100 + c) / 200)})
    g = curves.groupBy("grid_id").agg(F.percentile(value, F.array(*[F.lit(c) for c in cuts])).alias("p"))
    rows = F.array(*[F.struct(F.lit(c).alias("level"), F.col("p")[cuts.index((100 - c) / 200)].alias("ci_lower"), F.col("p")[cuts.index((100 + c) / 200)].alias("ci_upper")) for c in levels])
    return g.select("grid_id", F.explode(rows).alias("r")).select("grid_id", "r.*")


def envelope(curve: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Running maximum in grid order."""
    w = Window.partitionBy(*by).orderBy("grid_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return curve.withColumn("envelope", F.max(value).over(w))


def reliability_points(curve: DataFrame, x: str, value: str, targets: Sequence[float] = TARGETS, by: Sequence[str] = ()) -> DataFrame:
    """(by..., target, x at which the running maximum reaches the target); NULL where it never does.

    Between grid points the running maximum is linear; a target below the first value gives the
    first point.
    """
    rising = envelope(curve, value, by)
    w = Window.partitionBy(*by).orderBy("grid_id")
    steps = rising.select(*by, "grid_id", F.col(f"`{x}`").alias("x1"), F.col("envelope").alias("y1"), F.lag(F.col(f"`{x}`")).over(w).alias("x0"), F.lag("envelope").over(w).alias("y0"))
    goals = F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    hit = steps.select("*", goals).withColumn("at", F.when(F.col("y1") < F.col("target"), None).when(F.col("x0").isNull() | (F.col("y1") == F.col("y0")), F.col("x1")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("target") - F.col("y0")) / (F.col("y1") - F.col("y0"))))
    return hit.groupBy(*by, "target").agg(F.min(F.struct(F.col("at").isNull().alias("never"), "grid_id", "at")).alias("m")).select(*by, "target", F.col("m.at").alias(x))


def reliability_point(curve: DataFrame, x: str, value: str, target: float = 0.9) -> float | None:
    return reliability_points(curve, x, value, [target]).first()[x]


def reliability_table(bounds: DataFrame, grid: DataFrame, x: str, targets: Sequence[float] = TARGETS) -> DataFrame:
    """(level, target, x) of all confidence levels and targets, from the lower bounds."""
    joined = bounds.join(F.broadcast(grid.select("grid_id", x)), "grid_id")  # a grid has a fixed size
    return reliability_points(joined, x, "ci_lower", targets, ["level"])


def convergence_trace(predictions: DataFrame) -> DataFrame:
    """Of (replicate, probe, prediction): replicate, avg_width, max_width of the relative spread so far."""
    w = Window.partitionBy("probe").orderBy("replicate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    width = F.coalesce(F.stddev_pop("prediction").over(w), F.lit(0.0)) / (F.abs(F.avg("prediction").over(w)) + 1e-6)
    return predictions.withColumn("width", width).groupBy("replicate").agg(F.avg("width").alias("avg_width"), F.max("width").alias("max_width"))
