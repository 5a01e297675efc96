"""Error distributions: survival as Columns where a closed form exists, and all families in numpy.

Parameters are (shapes..., loc, scale).  A scale that is not positive gives NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special

#: Candidates in the order in which ties are broken, with the number of shape parameters.
FAMILIES = {"norm": 0, "gumbel_r": 0, "gumbel_l": 0, "weibull_min": 1, "weibull_max": 1, "gamma": 1, "expon": 0, "logistic": 0, "laplace": 0, "t": 1, "beta": 2, "uniform": 0}
SIGMA_FLOOR = 1e-10

# Abramowitz and Stegun 26.2.17, for the normal CDF where no erf exists; error below 7.5e-8.
AS_P = "0.2316419e0"
AS_B = ("0.319381530e0", "-0.356563782e0", "1.781477937e0", "-1.821255978e0", "1.330274429e0")


def norm_cdf_sql(z: str) -> str:
    """Normal CDF as one SQL text that Spark and DuckDB read alike."""
    t = f"(1e0/(1e0+{AS_P}*abs({z})))"
    poly = AS_B[-1]
    for b in reversed(AS_B[:-1]):
        poly = f"({b}+{t}*{poly})"
    tail = f"(0.3989422804014327e0*exp(-0.5e0*({z})*({z}))*{t}*{poly})"
    return f"(CASE WHEN ({z}) >= 0e0 THEN 1e0-{tail} ELSE {tail} END)"


def norm_cdf(z: Column) -> Column:
    t = 1.0 / (1.0 + float(AS_P[:-2]) * F.abs(z))
    poly = F.lit(float(AS_B[-1][:-2]))
    for b in reversed(AS_B[:-1]):
        poly = float(b[:-2]) + t * poly
    tail = 0.3989422804014327 * F.exp(-0.5 * z * z) * t * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def survival(z: Column, family: str, params: Sequence[float]) -> Column:
    """P(Z > z) as a Column, clamped to [0, 1]."""
    *shape, loc, scale = map(float, params)
    if not scale > 0:
        return F.lit(None).cast("double")
    s = (z - loc) / scale
    if family == "norm":
        out = 1.0 - norm_cdf(s)
    elif family == "gumbel_r":
        out = 1.0 - F.exp(-F.exp(-s))
    elif family == "gumbel_l":
        out = F.exp(-F.exp(s))
    elif family == "logistic":
        out = 1.0 / (1.0 + F.exp(s))
    elif family == "laplace":
        out = F.when(s < 0, 1.0 - 0.5 * F.exp(s)).otherwise(0.5 * F.exp(-s))
    elif family == "expon":
        out = F.when(s < 0, 1.0).otherwise(F.exp(-s))
    elif family == "uniform":
        out = 1.0 - s
    elif family == "weibull_min":
        out = F.when(s <= 0, 1.0).otherwise(F.exp(-F.pow(F.greatest(s, F.lit(0.0)), F.lit(shape[0]))))
    elif family == "weibull_max":
        out = F.when(s >= 0, 0.0).otherwise(1.0 - F.exp(-F.pow(F.greatest(-s, F.lit(0.0)), F.lit(shape[0]))))
    else:
        # Incomplete gamma and beta functions have no Column form.
        fixed = tuple(map(float, params))

        def arrow(x: pd.Series) -> pd.Series:
            return pd.Series(np.clip(1 - cdf(x.to_numpy(), family, fixed), 0, 1))

        return F.pandas_udf(arrow, "double")(z)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def exceedance(mean: Column, sigma: Column, threshold: Column, family: str, params: Sequence[float], floor: float = SIGMA_FLOOR) -> Column:
    """P(mean + sigma * Z > threshold)."""
    return survival((threshold - mean) / F.greatest(sigma, F.lit(floor)), family, params)


def log_pdf(x, family: str, params: Sequence[float]) -> np.ndarray:
    *shape, loc, scale = params
    z = (np.asarray(x, float) - loc) / scale
    with np.errstate(all="ignore"):
        if family == "norm":
            out = -0.5 * z * z - 0.5 * math.log(2 * math.pi)
        elif family == "gumbel_r":
            out = -z - np.exp(-z)
        elif family == "gumbel_l":
            out = z - np.exp(z)
        elif family == "logistic":
            out = -np.abs(z) - 2 * np.log1p(np.exp(-np.abs(z)))
        elif family == "laplace":
            out = -np.abs(z) - math.log(2)
        elif family == "expon":
            out = np.where(z >= 0, -z, -np.inf)
        elif family == "uniform":
            out = np.where((z >= 0) & (z <= 1), 0.0, -np.inf)
        elif family in ("weibull_min", "weibull_max"):
            y = z if family == "weibull_min" else -z
            c = shape[0]
            out = np.where(y > 0, math.log(c) + (c - 1) * np.log(np.maximum(y, 1e-300)) - np.maximum(y, 0) ** c, -np.inf)
        elif family == "gamma":
            a = shape[0]
            out = np.where(z > 0, (a - 1) * np.log(np.maximum(z, 1e-300)) - z - special.gammaln(a), -np.inf)
        elif family == "t":
            v = shape[0]
            out = special.gammaln((v + 1) / 2) - special.gammaln(v / 2) - 0.5 * math.log(v * math.pi) - (v + 1) / 2 * np.log1p(z * z / v)
        elif family == "beta":
            a, b = shape
            inside = (z > 0) & (z < 1)
            y = np.where(inside, z, 0.5)
            out = np.where(inside, (a - 1) * np.log(y) + (b - 1) * np.log1p(-y) + special.gammaln(a + b) - special.gammaln(a) - special.gammaln(b), -np.inf)
        else:
            raise ValueError(f"unknown distribution {family!r}")
    return out - math.log(scale)


def cdf(x, family: str, params: Sequence[float]) -> np.ndarray:
    *shape, loc, scale = params
    z = (np.asarray(x, float) - loc) / scale
    with np.errstate(all="ignore"):
        if family == "norm":
            return special.norm_cdf(z)
        if family == "gumbel_r":
            return np.exp(-np.exp(-z))
        if family == "gumbel_l":
            return -np.expm1(-np.exp(z))
        if family == "logistic":
            return 1 / (1 + np.exp(-z))
        if family == "laplace":
            return np.where(z < 0, 0.5 * np.exp(z), 1 - 0.5 * np.exp(-z))
        if family == "expon":
            return np.where(z < 0, 0.0, -np.expm1(-z))
        if family == "uniform":
            return np.clip(z, 0, 1)
        if family == "weibull_min":
            return np.where(z > 0, -np.expm1(-np.maximum(z, 0) ** shape[0]), 0.0)
        if family == "weibull_max":
            return np.where(z < 0, np.exp(-np.maximum(-z, 0) ** shape[0]), 1.0)
        if family == "gamma":
            return special.gammainc(shape[0], z)
        if family == "t":
            v = shape[0]
            tail = 0.5 * special.betainc(v / 2, 0.5, v / (v + z * z))
            return np.where(z < 0, tail, 1 - tail)
        if family == "beta":
            return special.betainc(shape[0], shape[1], z)
    raise ValueError(f"unknown distribution {family!r}")


def ppf(u, family: str | Callable[..., np.ndarray], params: Sequence[float]) -> np.ndarray:
    """Inverse CDF; families without a closed form are inverted by bisection.

    A family may also be a function of (u, *shapes), the inverse CDF of its standard form.
    """
    *shape, loc, scale = params
    u = np.asarray(u, float)
    with np.errstate(all="ignore"):
        if callable(family):
            z = np.asarray(family(u, *shape), float)
        elif family == "norm":
            z = special.norm_ppf(u)
        elif family == "lognorm":
            z = np.exp(shape[0] * special.norm_ppf(u))
        elif family == "uniform":
            z = u
        elif family == "expon":
            z = -np.log1p(-u)
        elif family == "gumbel_r":
            z = -np.log(-np.log(u))
        elif family == "gumbel_l":
            z = np.log(-np.log1p(-u))
        elif family == "logistic":
            z = np.log(u) - np.log1p(-u)
        elif family == "laplace":
            z = np.where(u < 0.5, np.log(2 * u), -np.log(2 * (1 - u)))
        elif family == "weibull_min":
            z = (-np.log1p(-u)) ** (1 / shape[0])
        elif family == "weibull_max":
            z = -((-np.log(u)) ** (1 / shape[0]))
        elif family == "cauchy":
            z = np.tan(np.pi * (u - 0.5))
        elif family == "rayleigh":
            z = np.sqrt(-2 * np.log1p(-u))
        elif family == "halfnorm":
            z = special.norm_ppf((1 + u) / 2)
        elif family == "pareto":
            z = (1 - u) ** (-1 / shape[0])
        elif family == "triang":
            c = shape[0]
            z = np.where(u < c, np.sqrt(c * u), 1 - np.sqrt((1 - c) * (1 - u)))
        elif family == "loguniform":
            z = shape[0] * (shape[1] / shape[0]) ** u
        elif family == "truncnorm":
            low, high = special.norm_cdf(shape[0]), special.norm_cdf(shape[1])
            z = special.norm_ppf(low + u * (high - low))
        elif family == "chi2":
            z = ppf(u, "gamma", (shape[0] / 2, 0.0, 2.0))
        elif family in FAMILIES:
            unit = (*shape, 0.0, 1.0)
            lo, hi = np.full(u.shape, 0.0 if family in ("gamma", "beta") else -1e8), np.full(u.shape, 1.0 if family == "beta" else 1e8)
            for _ in range(200):
                mid = (lo + hi) / 2
                below = cdf(mid, family, unit) < u
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
            z = (lo + hi) / 2
        else:
            raise ValueError(f"unknown distribution {family!r}")
    return loc + scale * z


def ppf_column(u: Column, family: str | Callable[..., np.ndarray], params: Sequence[float]) -> Column:
    """Inverse CDF of a Column: native where closed, else Arrow.  The family may be a function, as for ``ppf``."""
    *shape, loc, scale = map(float, params)
    if family == "uniform":
        return loc + scale * u
    if family == "expon":
        return loc - scale * F.log1p(-u)
    if family == "weibull_min":
        return loc + scale * F.pow(-F.log1p(-u), F.lit(1 / shape[0]))
    if family == "logistic":
        return loc + scale * (F.log(u) - F.log1p(-u))
    if family == "gumbel_r":
        return loc - scale * F.log(-F.log(u))
    fixed = tuple(map(float, params))

    def arrow(x: pd.Series) -> pd.Series:
        return pd.Series(ppf(x.to_numpy(), family, fixed))

    return F.pandas_udf(arrow, "double")(u)
