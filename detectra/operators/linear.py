"""Classical linear signal model: regression, PoD curve, bootstrap bounds, all native aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, grids
from ..functions.distributions import norm_cdf


@dataclass(frozen=True)
class LinearModel:
    slope: float
    intercept: float
    tau: float
    xlog: bool = False
    ylog: bool = False

    def mean(self, x: Column) -> Column:
        """On the scale of the fit."""
        return self.intercept + self.slope * (F.log(x) if self.xlog else x)


#: A draw of Poisson(1) is how many of these a uniform draw exceeds.
POISSON_CUTS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def axes(df: DataFrame, x: str, y: str, xlog: bool, ylog: bool, row_id: str | None = None) -> DataFrame:
    a, b = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    key = [F.col(f"`{row_id}`").alias("key")] if row_id else []
    return df.select((F.log(a) if xlog else a).alias("x"), (F.log(b) if ylog else b).alias("y"), *key)


def regression(rows: DataFrame, *by: str) -> DataFrame:
    """slope, intercept, tau and n of (x, y) rows, by group: tau is sqrt(SSE / (n - 2))."""
    g = rows.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"), F.count(F.lit(1)).alias("n"))
    sse = F.greatest(F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    return g.select(*by, "slope", "intercept", F.sqrt(F.try_divide(sse, F.col("n") - 2)).alias("tau"), "n")


def fit_linear_a_hat_model(df: DataFrame, x: str, y: str, xlog: bool = False, ylog: bool = False) -> LinearModel:
    r = regression(axes(df, x, y, xlog, ylog)).first()
    return LinearModel(r["slope"], r["intercept"], r["tau"], xlog, ylog)


def compute_linear_pod_curve(grid: DataFrame, name: str, model: LinearModel, threshold: float) -> DataFrame:
    """The grid with mean_response, on the signal's own scale, and pod."""
    mean = model.mean(F.col(f"`{name}`"))
    limit = math.log(threshold) if model.ylog else float(threshold)
    pod = 1.0 - norm_cdf((F.lit(limit) - mean) / F.lit(max(model.tau, 1e-300)))
    return grid.withColumns({"mean_response": F.exp(mean) if model.ylog else mean, "pod": pod})


def study_grid(df: DataFrame, x: str, n: int = 100) -> DataFrame:
    lo, hi = df.agg(F.min(f"`{x}`").cast("double"), F.max(f"`{x}`").cast("double")).first()
    return grids.line(df.sparkSession, x, lo, hi, n)


def resamples(rows: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """(replicate, x, y): rows drawn with replacement by keyed draws, joined by row number.

    Row numbers come from a sort by the values, so retries agree; the draws, not the rows, are
    shuffled once for each replicate.
    """
    from pyspark.sql import Window

    n = rows.count()
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy("x", "y")) - 1)
    spark: SparkSession = rows.sparkSession
    drawn = spark.range(0, n_boot).withColumnRenamed("id", "replicate").select("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    drawn = drawn.select("replicate", draws.index(n, F.lit(seed), F.col("replicate"), F.col("k")).alias("i"))
    return drawn.join(numbered, "i").select("replicate", "x", "y")


def weighted_resamples(rows: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """slope, intercept, tau and n by replicate with Poisson(1) weights: one pass, no sort, no join.

    For tables of any size: each row's weight in each replicate is a draw keyed by the row's ``key``, and
    sums are combined before the shuffle.  Rows without a key are keyed by x and y, so equal rows share
    their weights there.
    """
    key = ["key"] if "key" in rows.columns else ["x", "y"]
    u = draws.uniform(F.lit(seed), F.col("replicate"), *[F.col(k) for k in key])
    weight = sum((F.when(u > c, 1.0).otherwise(0.0) for c in POISSON_CUTS), F.lit(0.0))
    w = rows.select("x", "y", *[k for k in key if k == "key"], F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate")).withColumn("w", weight).filter("w > 0")
    s = {k: F.sum(v) for k, v in {"n": F.col("w"), "sx": F.col("w") * F.col("x"), "sy": F.col("w") * F.col("y"), "xx": F.col("w") * F.col("x") ** 2, "xy": F.col("w") * F.col("x") * F.col("y"), "yy": F.col("w") * F.col("y") ** 2}.items()}
    g = w.groupBy("replicate").agg(*[v.alias(k) for k, v in s.items()])
    sxx, sxy, syy = F.expr("xx - sx*sx/n"), F.expr("xy - sx*sy/n"), F.expr("yy - sy*sy/n")
    slope = F.try_divide(sxy, sxx)
    return g.select("replicate", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"), F.sqrt(F.try_divide(F.greatest(syy - slope * sxy, F.lit(0.0)), F.greatest(F.col("n") - 2, F.lit(0.0)))).alias("tau"), "n")


def bootstrap_curves(df: DataFrame, grid: DataFrame, x: str, y: str, threshold: float, n_boot: int = 1000, xlog: bool = False, ylog: bool = False, seed: int = 0, exact_rows: int = 200_000) -> DataFrame:
    """(replicate, grid_id, pod) of refits; tables of more than ``exact_rows`` rows use Poisson weights."""
    rows = axes(df, x, y, xlog, ylog)
    small = rows.limit(exact_rows + 1).count() <= exact_rows
    fits = regression(resamples(rows, n_boot, seed), "replicate") if small else weighted_resamples(rows, n_boot, seed)
    at = F.log(F.col(f"`{x}`")) if xlog else F.col(f"`{x}`")
    limit = math.log(threshold) if ylog else float(threshold)
    z = (F.lit(limit) - (F.col("intercept") + F.col("slope") * at)) / F.greatest("tau", F.lit(1e-300))
    # The grid has a fixed number of points.
    return fits.crossJoin(F.broadcast(grid)).select("replicate", "grid_id", F.col(f"`{x}`"), (1.0 - norm_cdf(z)).alias("pod"))
