"""Inference of the error distribution of standardised residuals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions, draws
from ..functions.distributions import FAMILIES
from ..sources import checkpoint
from . import likelihood
from .validate import quantiles

#: Values up to which fits run on the driver; beyond, over all rows in passes.
FIT_ROWS = 20_000
#: Passes over all rows at most: regular fits need a few, those that run towards another family's limit would go on.
PASSES = 30
DEFAULT = ("norm", (0.0, 1.0))


def starts(m: float, s: float, lo: float, hi: float, skew: float) -> list[tuple[str, tuple[float, ...]]]:
    """(family, parameters) to begin with, from mean, deviation, range and skewness."""
    s = s or 1.0
    wide, scale = s * math.sqrt(6) / math.pi, max(m - lo, 0.1 * s)
    a = min(max(4 / max(abs(skew), 0.05) ** 2, 0.5), 400.0)
    from_lo, from_hi = m - lo + 0.1 * s, hi - m + 0.1 * s
    out = [("gumbel_r", (m - 0.5772 * wide, wide)), ("gumbel_l", (m + 0.5772 * wide, wide)), ("logistic", (m, s * math.sqrt(3) / math.pi))]
    out += [("weibull_min", (c, lo - 0.1 * s, from_lo)) for c in (1.2, 2.0, 3.6)]
    out += [("weibull_max", (c, hi + 0.1 * s, from_hi)) for c in (1.2, 2.0, 3.6)]
    out += [("gamma", (a, min(m - s * math.sqrt(a), lo - 0.01 * s), s / math.sqrt(a))), ("gamma", (2.0, lo - 0.1 * s, scale / 2))]
    out += [("t", (4.0, m, s * 0.7)), ("t", (20.0, m, s * 0.95))]
    share = min(max((m - lo + 0.05 * s) / (hi - lo + 0.1 * s), 0.05), 0.95)
    both = min(max(share * (1 - share) * ((hi - lo + 0.1 * s) / s) ** 2 - 1, 0.5), 1e3)
    return [*out, ("beta", (share * both, (1 - share) * both, lo - 0.05 * s, hi - lo + 0.1 * s)), ("beta", (2.0, 2.0, lo - 0.05 * s, hi - lo + 0.1 * s))]


def moments_of(z: np.ndarray) -> tuple[float, float, float, float, float]:
    m, s = float(z.mean()), float(z.std())
    return m, s, float(z.min()), float(z.max()), float(np.mean(((z - m) / (s or 1.0)) ** 3))


def fit(z: np.ndarray, family: str) -> tuple[float, ...]:
    """Maximum-likelihood parameters (shapes..., loc, scale)."""
    if family == "norm":
        return (float(z.mean()), float(z.std()))
    if family == "laplace":
        loc = float(np.median(z))
        return (loc, float(np.abs(z - loc).mean()))
    if family == "expon":
        return (float(z.min()), float(z.mean() - z.min()))
    if family == "uniform":
        return (float(z.min()), float(z.max() - z.min()))
    if family not in likelihood.KERNELS:
        raise ValueError(f"unknown distribution {family!r}")
    own = moments_of(z)
    found = likelihood.climb(len(z), own[2], own[3], [x for x in starts(*own) if x[0] == family], likelihood.over_array(z))
    if family not in found:
        raise ValueError(f"{family} cannot be fitted")
    return found[family][0]


def aic(z: np.ndarray, family: str, params: tuple[float, ...]) -> float:
    return 2 * len(params) - 2 * float(np.sum(distributions.log_pdf(z, family, params)))


def best_of(z: np.ndarray, families=tuple(FAMILIES)) -> tuple[str, tuple[float, ...]]:
    """The family with the least AIC; of ties the first.  Standard normal where none can be fitted."""
    best, least = DEFAULT, math.inf
    if not len(z) or not np.all(np.isfinite(z)):
        return best
    for family in families:
        try:
            params = fit(z, family)
            value = aic(z, family, params)
        except (ValueError, FloatingPointError, OverflowError, ZeroDivisionError):
            continue
        if value < least:
            best, least = (family, params), value
    return best


def newton_fits(rows: DataFrame, value: str, most: int = FIT_ROWS) -> dict[str, tuple[tuple[float, ...], float]]:
    """(parameters, log-likelihood) of each family without closed-form estimates, over all rows.

    Beyond ``most`` rows the steps begin at the fits of a keyed sample of that size, which only saves passes.
    """
    v = F.col(value)
    n, m, s, lo, hi, skew = rows.agg(F.count(v), F.avg(v), F.stddev_pop(v), F.min(v), F.max(v), F.skewness(v)).first()
    if not n:
        return {}
    sample = rows.filter(draws.uniform(F.lit(13), F.xxhash64(value)) < most / n) if n > most else rows
    z = np.array([r[0] for r in sample.select(value).orderBy(value).limit(2 * most).collect()], float)
    begin = starts(m, s, lo, hi, skew if skew is not None and math.isfinite(skew) else 0.0)
    if n <= most:
        return likelihood.climb(n, lo, hi, begin, likelihood.over_array(z))
    near = likelihood.climb(len(z), lo, hi, begin, likelihood.over_array(z)) if len(z) else {}
    begin = [(f, p) for f, (p, _) in near.items()] + [x for x in begin if x[0] not in near]
    return likelihood.climb(n, lo, hi, begin, likelihood.over_rows(rows, value), PASSES)


def all_fits(rows: DataFrame, value: str, families=tuple(FAMILIES)) -> list[tuple[str, tuple[float, ...], float]]:
    """(family, parameters, AIC) of all families that can be fitted, over all rows."""
    closed = {r["family"]: ((r["loc"], r["scale"]), r["aic"]) for r in closed_form_fits(rows, value).collect()}
    closed |= {f: (p, 2 * len(p) - 2 * v) for f, (p, v) in newton_fits(rows, value).items()}
    return [(f, *closed[f]) for f in families if f in closed and closed[f][1] is not None and math.isfinite(closed[f][1])]


def infer_best_distribution(train: DataFrame, sigma: DataFrame, key: str, residual: str = "residual") -> tuple[str, tuple[float, ...]]:
    """Of (key, residual) rows and their (key, sigma): family and parameters of residual / sigma, over all rows.

    The family with the least AIC, of ties the first; standard normal where none can be fitted or a value is not finite.
    """
    rows = train.select(key, residual).join(sigma.select(F.col(key).alias("__k"), "sigma"), F.col(key) == F.col("__k"))
    rows = checkpoint.cut(rows.select((F.col(residual).cast("double") / F.col("sigma")).alias("z")))
    if rows.isEmpty() or not rows.filter(F.col("z").isNull() | ~(F.abs("z") < math.inf)).isEmpty():
        return DEFAULT
    family, params, _ = min(all_fits(rows, "z"), key=lambda f: f[2], default=(*DEFAULT, 0.0))
    return family, params


def closed_form_fits(df: DataFrame, value: str) -> DataFrame:
    """(family, loc, scale, aic) of the families whose estimates are aggregates, over all rows natively."""
    v = F.col(value)
    a = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.lit(quantiles(df, {value: v}, (0.5,))[value][0]).cast("double").alias("med"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    one = df.select(v.alias("__v")).crossJoin(F.broadcast(a)).groupBy("n", "m", "s", "med", "lo", "hi").agg(F.avg(F.abs(F.col("__v") - F.col("med"))).alias("b"))  # one row of statistics
    n, width = F.col("n"), F.col("hi") - F.col("lo")
    rows = [
        ("norm", F.col("m"), F.col("s"), 4 + n * (F.log(2 * math.pi * F.col("s") * F.col("s")) + 1)),
        ("expon", F.col("lo"), F.col("m") - F.col("lo"), 4 + 2 * n * (F.log(F.col("m") - F.col("lo")) + 1)),
        ("laplace", F.col("med"), F.col("b"), 4 + 2 * n * (F.log(2 * F.col("b")) + 1)),
        ("uniform", F.col("lo"), width, 4 + 2 * n * F.log(width)),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("family"), loc.alias("loc"), scale.alias("scale"), a.alias("aic")) for f, loc, scale, a in rows])).alias("r")).select("r.*")


def nuisance_parameters(df: DataFrame, name: str) -> dict[str, tuple[str, tuple[float, ...]]]:
    """Normal, lognormal and Weibull distributions of a column by simple estimates."""
    v = F.col(f"`{name}`").cast("double")
    log = F.when(v > 0, F.log(v))
    r = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.avg(log).alias("lm"), F.stddev_samp(log).alias("ls")).first()
    return {
        "Normal": ("norm", (r["m"], r["s"] or 1.0)),
        "Lognormal": ("lognorm", (r["ls"] or 0.5, 0.0, math.exp(r["lm"]) if r["lm"] is not None else 1.0)),
        "Weibull": ("weibull_min", (1.5, 0.0, r["m"])),
    }
