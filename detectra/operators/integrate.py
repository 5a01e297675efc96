"""Probability of detection over grids: fast path, Monte Carlo marginalisation, threshold spectra."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions, grids
from . import design, gauss, variance

SAMPLES = 3000
BROADCAST_CELLS = 4_000_000
#: Pairs of points and training rows that are met directly.
DIRECT = 100_000_000

Dists = Mapping[str, tuple[str, Sequence[float] | float]]


def compute_pod_curve(curve: DataFrame, mean: str, sigma: str, family: str, params: Sequence[float], threshold: float | Column) -> DataFrame:
    """The rows with pod = P(mean + sigma * Z > threshold)."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return curve.withColumn("pod", distributions.exceedance(F.col(mean), F.col(sigma), limit, family, params, floor=0.0))


def poi_grid(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """100 points of one parameter of interest, or 30 x 30 of two, over the data's range."""
    if len(names) not in (1, 2):
        raise ValueError("one or two parameters of interest are supported")
    v = df.agg(*[f(F.col(f"`{c}`").cast("double")) for c in names for f in (F.min, F.max)]).first()
    spark = df.sparkSession
    return grids.line(spark, names[0], v[0], v[1], 100) if len(names) == 1 else grids.mesh(spark, tuple(names), (v[0], v[2]), (v[1], v[3]), 30)


def nuisance_sample(spark, ranges: Mapping[str, tuple[float, float]], dists: Dists | None = None, n: int = SAMPLES, seed: int = 42) -> DataFrame:
    """(sample_id, nuisances): a Latin hypercube over all nuisances; those with a distribution go through its inverse CDF."""
    names, dists = list(ranges), dists or {}
    u = design.unit_lhs(spark, n, len(names), seed)
    cols = []
    for j, c in enumerate(names):
        lo, hi = ranges[c]
        if lo == hi:
            cols.append(F.lit(float(lo)).alias(c))
        elif c in dists:
            family, params = dists[c]
            cols.append(distributions.ppf_column(F.col(f"u{j}"), family, params if isinstance(params, (tuple, list)) else (params,)).alias(c))
        else:
            cols.append(design.scale(F.col(f"u{j}"), lo, hi).alias(c))
    return u.select(F.col("id").alias("sample_id"), *cols)


def compute_multi_dim_pod(grid: DataFrame, ranges: Mapping[str, tuple[float, float]], model, train: DataFrame, bandwidth: float, dist: tuple[str, Sequence[float]], thresholds: float | Sequence[float], dists: Dists | None = None, n_mc: int = SAMPLES, seed: int = 42) -> DataFrame:
    """(grid_id, threshold, pod, mean_response) over grid points, averaged over the nuisances.

    Nuisances whose range is a point are literals; if all are, no sample is drawn.  Every grid point
    meets the same sample.  ``train`` has the inputs and residuals.
    """
    inputs, spark = list(model.inputs), grid.sparkSession
    limits = [float(t) for t in (thresholds if isinstance(thresholds, (list, tuple, np.ndarray)) else [thresholds])]
    active = [c for c, (lo, hi) in ranges.items() if lo != hi]
    if active:
        sample = nuisance_sample(spark, ranges, dists, n_mc, seed)
        # The sample has n_mc rows, a fixed number.
        points = grid.crossJoin(F.broadcast(sample)).withColumn("point", F.col("grid_id") * n_mc + F.col("sample_id"))
    else:
        points = grid.withColumns({c: F.lit(float(v[0])) for c, v in ranges.items()}).withColumn("point", F.col("grid_id"))
    points = variance.predict(points.select("grid_id", "point", *inputs), model, "mean")
    noisy = with_sigma(points, train, inputs, bandwidth)
    family, params = dist
    cut = F.explode(F.array(*[F.lit(t) for t in limits]))
    rows = noisy.select("grid_id", "mean", "sigma", cut.alias("threshold"))
    pod = distributions.exceedance(F.col("mean"), F.col("sigma"), F.col("threshold"), family, params)
    return rows.withColumn("pod", pod).groupBy("grid_id", "threshold").agg(F.avg("pod").alias("pod"), F.avg("mean").alias("mean_response"))


def with_sigma(points: DataFrame, train: DataFrame, inputs: Sequence[str], bandwidth: float, residual: str = "residual") -> DataFrame:
    """Points with sigma.

    Beyond DIRECT pairs of a point and a training row a fast Gauss transform is used where its lattice is
    small enough.  Else training rows up to BROADCAST_CELLS numbers are broadcast and smoothed in
    blocks, and more are met by local_std."""
    most = BROADCAST_CELLS // (len(inputs) + 1)
    rows = train.select(*inputs, residual)
    if points.count() * rows.count() > DIRECT and bandwidth > 0:
        xs = [f"x{i}" for i in range(len(inputs))]
        squares = rows.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(inputs, xs)], (F.col(f"`{residual}`") * F.col(f"`{residual}`")).alias("r2"))
        (lo, hi), (low, high) = variance.box(squares, xs), variance.box(points.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(inputs, xs)]), xs)
        lo, hi = np.minimum(lo, low), np.maximum(hi, high)
        if gauss.Transform.fits(lo, hi, bandwidth):
            return gauss.beside(gauss.Transform(squares, xs, "r2", lo, hi, bandwidth), points, list(inputs), bandwidth, variance.WEIGHT_FLOOR, variance.WEIGHT_LEAST)
    if rows.limit(most + 1).count() > most:
        sigma = variance.local_std(points, train, inputs, bandwidth, "point", residual)
        return points.join(sigma.withColumnRenamed("point", "__p"), F.col("point") == F.col("__p")).drop("__p")
    pdf = rows.orderBy(*rows.columns).toPandas()
    shared = points.sparkSession.sparkContext.broadcast((pdf[list(inputs)].to_numpy(float), pdf[residual].to_numpy(float) ** 2))
    names = points.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        X, r2 = shared.value
        for b in batches:
            x = np.stack([np.asarray(b.column(c), float) for c in inputs], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(variance.smooth(X, r2, x, bandwidth))], names=[*names, "sigma"])

    spread = points.repartition(points.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("sigma", T.DoubleType())]))


def threshold_spectrum(grid: DataFrame, ranges, model, train: DataFrame, outcome: str, bandwidth: float, dist, dists=None, n: int = 100, n_mc: int = SAMPLES) -> DataFrame:
    """(grid_id, threshold, pod, mean_response) for n thresholds over the outcome's range."""
    lo, hi = train.agg(F.min(outcome), F.max(outcome)).first()
    return compute_multi_dim_pod(grid, ranges, model, train, bandwidth, dist, list(np.linspace(lo, hi, n)), dists, n_mc)


def spectrum_lookup(spectrum: DataFrame, threshold: float) -> DataFrame:
    """(grid_id, pod, mean_response) at a threshold, linear between the spectrum's thresholds."""
    g = spectrum.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("threshold", "pod"))).alias("s"), F.first("mean_response").alias("mean_response"))
    xs, ys = F.transform("s", lambda v: v["threshold"]), F.transform("s", lambda v: v["pod"])
    return g.select("grid_id", grids.interpolate(F.lit(float(threshold)), xs, ys).alias("pod"), "mean_response")


def representative_rows(n: int) -> list[int]:
    """Five grid rows at a tenth, three, five, seven and nine tenths, without repeats."""
    return sorted({min(max(int(n * f), 0), n - 1) for f in (0.1, 0.3, 0.5, 0.7, 0.9)})


def pod_vs_threshold(spectrum: DataFrame, n_grid: int = 100) -> DataFrame:
    return spectrum.filter(F.col("grid_id").isin(representative_rows(n_grid))).select("grid_id", "threshold", "pod")
