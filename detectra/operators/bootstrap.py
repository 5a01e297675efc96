"""Bootstrap of polynomial and Kriging PoD curves.

Up to MOST_CELLS numbers of training data a replicate is one task row, which resamples the rows that all
tasks share.  Beyond, polynomial replicates are made of Poisson weights over all rows, in passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions
from . import errors, kriging, polynomial, reliability, replicates, variance
from . import progress as progressing

SAMPLES = 500
#: Numbers of training data that may be broadcast, and rows that a replicate works on at a time.
MOST_CELLS, PART = 8_000_000, 1 << 14


def lhs(n: int, d: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    return (np.stack([r.permutation(n) for _ in range(d)], 1) + r.random((n, d))) / n


def places(grid: np.ndarray, names: Sequence[str], poi: Sequence[str], ranges, dists, n_mc: int) -> np.ndarray:
    """Where a curve is evaluated: the same draws of the other inputs at each row of the grid."""
    active = [c for c, (lo, hi) in ranges.items() if lo != hi]
    draws = lhs(n_mc, len(ranges), 42) if active else np.zeros((1, max(len(ranges), 1)))
    points = np.empty((len(grid) * len(draws), len(names)))
    for i, c in enumerate(names):
        if c in poi:
            points[:, i] = np.repeat(grid[:, poi.index(c)], len(draws))
        else:
            j = list(ranges).index(c)
            lo, hi = ranges[c]
            v = np.full(len(draws), lo) if lo == hi else distributions.ppf(draws[:, j], *dists[c]) if c in dists else lo + draws[:, j] * (hi - lo)
            points[:, i] = np.tile(v, len(grid))
    return points


def replicate_pod(b: int, X, y, points, n_grid, names, kind, bandwidth, family, limits) -> np.ndarray:
    """PoD (grid x thresholds) of one resample: same degree or kernel, same family, same bandwidth."""
    if kind[0] == "Polynomial":
        lattice = variance.Lattice(np.minimum(X.min(0), points.min(0)), np.maximum(X.max(0), points.max(0)), bandwidth)
        if lattice.fits:
            return counted_pod(b, X, y, points, n_grid, names, kind, bandwidth, family, limits, max(PART, lattice.size))
    pick = np.random.default_rng(b).integers(0, len(X), len(X))
    Xb, yb = X[pick], y[pick]
    model = polynomial.fit_arrays(Xb, yb, names, kind[1]) if kind[0] == "Polynomial" else kriging.refit(kind[1], Xb, yb, names)
    r = yb - model.predict(Xb)
    r2 = r * r
    z = r / np.maximum(variance.smooth_binned(Xb, r2, Xb, bandwidth), 1e-300)
    try:
        params = errors.fit(z, family)
    except (ValueError, FloatingPointError, OverflowError):
        params = (0.0, 1.0)
    return exceeding(model.predict(points), variance.smooth_binned(Xb, r2, points, bandwidth), n_grid, family, params, limits)


def exceeding(mean: np.ndarray, sigma: np.ndarray, n_grid: int, family: str, params, limits) -> np.ndarray:
    sigma = np.maximum(sigma, distributions.SIGMA_FLOOR)
    out = [np.clip(1 - distributions.cdf((t - mean) / sigma, family, params), 0, 1).reshape(n_grid, -1).mean(1) for t in limits]
    return np.stack(out, 1)


def counted_pod(b: int, X, y, points, n_grid, names, kind, bandwidth, family, limits, part: int) -> np.ndarray:
    """``replicate_pod`` of a polynomial from how often each row is drawn, in parts of the rows.

    Beside the shared rows a replicate holds a count for each row, and for families other than the normal its z.
    """
    n, random = len(X), np.random.default_rng(b)
    counts = np.zeros(n, np.uint32)
    for s in range(0, n, part):  # the same draws as at once
        np.add.at(counts, random.integers(0, n, min(part, n - s)), 1)

    def parts():
        for s in range(0, n, part):
            w = counts[s : s + part]
            live = w > 0
            if live.any():
                yield X[s : s + part][live], y[s : s + part][live], w[live].astype(float)

    model = polynomial.fit_weighted(parts, names, kind[1])
    lo, hi = points.min(0), points.max(0)
    for x, _, _ in parts():
        lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
    lattice = variance.Lattice(lo, hi, bandwidth)
    for x, v, w in parts():
        lattice.add(x, w, (v - model.predict(x)) ** 2)
    lattice.smooth()

    def standardised():
        for x, v, w in parts():
            yield (v - model.predict(x)) / np.maximum(lattice.read(x), 1e-300), w

    try:
        if family == "norm":
            near, first, second = None, 0.0, 0.0
            for z, w in standardised():  # about a value near the mean, so that squares do not cancel
                near = w @ z / w.sum() if near is None else near
                first, second = first + w @ (z - near), second + w @ (z - near) ** 2
            params = (float(near + first / n), float(np.sqrt(max(second / n - (first / n) ** 2, 0.0))))
        else:
            z, at = np.empty(n), 0
            for own, w in standardised():
                own = np.repeat(own, w.astype(np.int64))
                z[at : at + len(own)] = own
                at += len(own)
            params = errors.fit(z, family)
    except (ValueError, FloatingPointError, OverflowError):
        params = (0.0, 1.0)
    return exceeding(model.predict(points), lattice.read(points), n_grid, family, params, limits)


def bootstrap_curves(df: DataFrame, inputs: Sequence[str], outcome: str, grid: DataFrame, poi: Sequence[str], ranges: Mapping[str, tuple[float, float]], kind, bandwidth: float, family: str, threshold: float, n_boot: int = 1000, n_mc: int = SAMPLES, dists=None, progress: Callable[[int, int], None] | None = None, params: Sequence[float] | None = None) -> DataFrame:
    """(replicate, grid_id, pod).

    With ``progress`` the curves are made at once, and progress(done, total) is called on the driver as tasks
    end; what it raises is ignored.  ``params`` are the family's parameters for the whole table, from which
    fits over all rows begin.
    """
    spark = df.sparkSession
    most = MOST_CELLS // (len(inputs) + 1)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in [*inputs, outcome]])
    n = rows.count()
    ids = [r["grid_id"] for r in grid.select("grid_id").orderBy("grid_id").collect()]
    points = grid.orderBy("grid_id").select(*poi).toPandas().to_numpy(float)
    fixed = {c: (v[0], tuple(v[1]) if isinstance(v[1], (tuple, list)) else (v[1],)) for c, v in (dists or {}).items()}
    at = places(points, list(inputs), list(poi), dict(ranges), fixed, n_mc)
    if n > most and kind[0] == "Polynomial":
        if not params:
            params = next((p for f, p in errors.starts(0.0, 1.0, -4.0, 4.0, 0.5) if f == family), (0.0, 1.0))

        def exceed(mean: np.ndarray, sigma: np.ndarray, own: Sequence[float]) -> np.ndarray:
            return np.clip(1 - distributions.cdf((float(threshold) - mean) / np.maximum(sigma, distributions.SIGMA_FLOOR), family, own), 0, 1)

        return replicates.bootstrap(rows, inputs, outcome, at, ids, kind[1], bandwidth, family, params, exceed, n_boot, progress=progress)
    pdf = rows.orderBy(*rows.columns).toPandas()
    shared = spark.sparkContext.broadcast((pdf[list(inputs)].to_numpy(float), pdf[outcome].to_numpy(float), at, len(points), list(inputs), kind, bandwidth, family, [float(threshold)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                pod = replicate_pod(k, *shared.value)[:, 0]
                yield pa.record_batch({"replicate": pa.array(np.full(len(ids), k)), "grid_id": pa.array(ids, pa.int64()), "pod": pa.array(pod)})

    parts = max(1, min(n_boot, 4 * spark.sparkContext.defaultParallelism))
    curves = spark.range(0, n_boot, numPartitions=parts).mapInArrow(run, "replicate long, grid_id long, pod double")
    return progressing.watched(curves, n_boot, progress)


def bootstrap_pod_ci(*args, levels: Sequence[int] | None = None, **kwargs) -> DataFrame:
    """(grid_id, level, ci_lower, ci_upper); without levels the 95 % bounds only."""
    return reliability.confidence_bounds(bootstrap_curves(*args, **kwargs), levels or (95,))
