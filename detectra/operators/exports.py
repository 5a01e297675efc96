"""The data behind each plot, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import checkpoint
from . import coverage, integrate, linear, validate, variance

HISTOGRAM_BINS = {"inspector": 25, "coverage": 20, "kriging": 15}


def signal_model(df: DataFrame, model, poi: str, fixed: dict[str, float], bandwidth: float, train: DataFrame) -> DataFrame:
    """grid_id, poi, mean, sigma, lower, upper: the mean and a band of two deviations."""
    grid = integrate.poi_grid(df, [poi]).withColumns({c: F.lit(float(v)) for c, v in fixed.items()})
    grid = variance.predict(grid, model, "mean")
    sigma = variance.local_std(grid, train, model.inputs, bandwidth).withColumnRenamed("grid_id", "g")
    return grid.join(sigma, F.col("grid_id") == F.col("g")).select("grid_id", poi, "mean", "sigma", (F.col("mean") - 2 * F.col("sigma")).alias("lower"), (F.col("mean") + 2 * F.col("sigma")).alias("upper"))


def linear_signal_model(df: DataFrame, x: str, model: linear.LinearModel) -> DataFrame:
    """grid_id, x, mean, lower, upper on the signal's own scale: a band of two tau."""
    grid = linear.study_grid(df, x)
    m = model.mean(F.col(f"`{x}`"))
    own = F.exp if model.ylog else (lambda c: c)
    return grid.select("grid_id", x, own(m).alias("mean"), own(m - 2 * model.tau).alias("lower"), own(m + 2 * model.tau).alias("upper"))


def histogram(df: DataFrame, name: str, bins: int) -> DataFrame:
    """bin, lo, hi, n, density of equal-width bins; the last bin holds its upper edge.

    The values are cut first: sums of doubles differ in their last bits from one evaluation to the next,
    and a least value of another evaluation would leave values below the first bin.
    """
    return binned(checkpoint.cut(df.select(F.col(f"`{name}`").cast("double").alias("x"))), "x", bins)


def binned(df: DataFrame, name: str, bins: int) -> DataFrame:
    """``histogram`` of a table that gives the same values each time."""
    v = df.select(F.col(f"`{name}`").alias("x")).filter("x is not null")
    lim = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("total"))
    b = v.crossJoin(F.broadcast(lim))  # one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    g = b.groupBy(at.alias("bin"), "lo", "hi", "total").agg(F.count("x").alias("n"))
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    return g.select("bin", (F.col("lo") + F.col("bin") * w).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * w).alias("hi"), "n", (F.col("n") / F.col("total") / w).alias("density"))


def density(df: DataFrame, name: str, n: int = 100) -> DataFrame:
    """grid_id, x, density: a Gaussian kernel estimate with Scott's bandwidth on n points."""
    v = df.select(F.col(f"`{name}`").cast("double").alias("x")).filter("x is not null")
    s = v.agg(F.count("x"), F.stddev_samp("x")).first()
    h = (s[1] or 1.0) * s[0] ** -0.2
    grid = linear.study_grid(v, "x", n).withColumnRenamed("x", "at")
    k = F.exp(-F.pow((F.col("at") - F.col("x")) / h, 2) / 2)
    return v.crossJoin(F.broadcast(grid)).groupBy("grid_id", "at").agg((F.sum(k) / (s[0] * h * float(np.sqrt(2 * np.pi)))).alias("density")).withColumnRenamed("at", "x")


def inspector(df: DataFrame, name: str, outcome: str) -> dict[str, DataFrame]:
    """Histogram, density, linear trend and largest gap of one variable."""
    trend = df.agg(F.regr_slope(F.col(outcome), F.col(name)).alias("slope"), F.regr_intercept(F.col(outcome), F.col(name)).alias("intercept"))
    return {"histogram": histogram(df, name, HISTOGRAM_BINS["inspector"]), "density": density(df, name), "trend": trend, "gap": coverage.gaps(df, [name])}


def coverage_panels(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable beside the columns of ``histogram``, of all inputs."""
    df, out = checkpoint.cut(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in names])), None
    for c in names:
        h = binned(df, c, HISTOGRAM_BINS["coverage"]).withColumn("variable", F.lit(c))
        out = h if out is None else out.unionByName(h)
    return out


def collinearity(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return validate.correlation_matrix(df, names)


def model_selection(scores: dict, spark) -> DataFrame:
    """ord, model, degree, mse, ratio to the least, sorted by error."""
    least = min(scores.values())
    rows = [(i, k[0], k[1], float(v), float(v / least) if least else 1.0) for i, (k, v) in enumerate(sorted(scores.items(), key=lambda x: x[1]))]
    return spark.createDataFrame(rows, "ord long, model string, degree int, mse double, ratio double")


def kriging_diagnostics(model, spark) -> DataFrame:
    """e and e / sqrt(gamma) of the leave-one-out residuals."""
    return spark.createDataFrame([(i, float(e), float(e / np.sqrt(model.gamma))) for i, e in enumerate(model.loo_residuals)], "row long, e double, scaled double")


def actual_vs_predicted(df: DataFrame, model, outcome: str) -> DataFrame:
    return variance.predict(df, model, "predicted").select(F.col(outcome).alias("actual"), "predicted")


def slider(df: DataFrame, name: str) -> dict[str, float | int]:
    """min, median, max, a hundredth of the range as step, and the decimals that the step needs."""
    s = validate.data_summary(df, name)
    if s["min"] is None:
        return s | {"step": None, "decimals": None}
    step = (s["max"] - s["min"]) / 100 or 1.0
    return s | {"step": step, "decimals": max(0, int(-np.floor(np.log10(step))))}
