"""Maximum likelihood of location-scale families over all rows, by damped Newton steps.

With x = (z - loc) / scale a family's log density is g(x; shapes) - log(scale) plus a normaliser of the
shapes.  One pass sums g, its derivatives and their products with x for all fits that are still
running; the driver turns the sums into gradients and Hessians in (log shapes, loc, log scale) and
proposes the next steps.  A step that does not improve the likelihood is damped and tried again.

Mirrored families (the left Gumbel, the Weibull of maxima) are fitted to -z.  Where a family's
support depends on its location, the support keeps ``MARGIN`` of the data's range from the data,
as some likelihoods grow without bound towards it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import special

MARGIN = 1e-7
STEPS, GAIN = 100, 1e-11
#: A fit that gains no more takes up to SETTLING plain Newton steps, until one is below SETTLED scales (or log units).
SETTLING, SETTLED = 4, 1e-10
#: Fitted families: the kernel they share, and whether values are mirrored.
KERNELS = {"gumbel_r": ("gumbel", 1), "gumbel_l": ("gumbel", -1), "logistic": ("logistic", 1), "weibull_min": ("weibull", 1), "weibull_max": ("weibull", -1), "gamma": ("gamma", 1), "t": ("t", 1), "beta": ("beta", 1)}
SHAPES = {"gumbel": 0, "logistic": 0, "weibull": 1, "gamma": 1, "t": 1, "beta": 2}


def kernel(x: np.ndarray, name: str, shape: Sequence[float]) -> tuple[tuple, list[tuple], list[np.ndarray]]:
    """(g, g', g''), for each shape the derivatives of g and g' by it, and the second derivatives of g by pairs of shapes."""
    if name == "gumbel":
        e = np.exp(-x)
        return (-x - e, e - 1, -e), [], []
    if name == "logistic":
        t, a = np.tanh(x / 2), np.abs(x)
        return (-a - 2 * np.log1p(np.exp(-a)), -t, (t * t - 1) / 2), [], []
    if name == "weibull":
        (c,) = shape
        log, w = np.log(x), x**c
        return ((c - 1) * log - w, (c - 1 - c * w) / x, -(c - 1) * (1 + c * w) / (x * x)), [(log - w * log, (1 - w - c * w * log) / x)], [-w * log * log]
    if name == "gamma":
        (a,) = shape
        log = np.log(x)
        return ((a - 1) * log - x, (a - 1) / x - 1, -(a - 1) / (x * x)), [(log, 1 / x)], [np.zeros_like(x)]
    if name == "t":
        (v,) = shape
        s = x * x
        q = v + s
        first = -0.5 * np.log1p(s / v) + (v + 1) / 2 * s / (v * q)
        second = s / (2 * v * q) + s / 2 * (v * q - (v + 1) * (2 * v + s)) / (v * q) ** 2
        return (-(v + 1) / 2 * np.log1p(s / v), -(v + 1) * x / q, -(v + 1) * (v - s) / (q * q)), [(first, -x / q + (v + 1) * x / (q * q))], [second]
    a, b = shape
    y = 1 - x
    low, high, zero = np.log(x), np.log(y), np.zeros_like(x)
    return ((a - 1) * low + (b - 1) * high, (a - 1) / x - (b - 1) / y, -(a - 1) / (x * x) - (b - 1) / (y * y)), [(low, 1 / x), (high, -1 / y)], [zero, zero, zero]


def normaliser(name: str, shape: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """A density's constant as a function of its shapes, with gradient and Hessian."""
    if name == "weibull":
        (c,) = shape
        return math.log(c), np.array([1 / c]), np.array([[-1 / (c * c)]])
    if name == "gamma":
        (a,) = shape
        return -math.lgamma(a), np.array([-special.digamma(a)]), np.array([[-special.trigamma(a)]])
    if name == "t":
        (v,) = shape
        value = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
        first = 0.5 * (special.digamma((v + 1) / 2) - special.digamma(v / 2) - 1 / v)
        return value, np.array([first]), np.array([[0.25 * (special.trigamma((v + 1) / 2) - special.trigamma(v / 2)) + 0.5 / (v * v)]])
    if name == "beta":
        a, b = shape
        both, low, high = special.trigamma(a + b), special.trigamma(a), special.trigamma(b)
        first = special.digamma(a + b) - np.array([special.digamma(a), special.digamma(b)])
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b), first, np.array([[both - low, both], [both, both - high]])
    return 0.0, np.zeros(0), np.zeros((0, 0))


def sums(z: np.ndarray, family: str, params: Sequence[float], weight: np.ndarray | None = None) -> np.ndarray:
    """What a batch of values adds to the sums of a fit; values may have weights."""
    name, sign = KERNELS[family]
    *shape, loc, scale = params
    x = (sign * z - loc) / scale
    with np.errstate(all="ignore"):
        (g, g1, g2), by, pairs = kernel(x, name, shape)
        out = [g, g1, x * g1, g2, x * g2, x * x * g2, *(v for a, b in by for v in (a, b, x * b)), *pairs]
        return np.array([v.sum() if weight is None else v @ weight for v in out])


def derivatives(n: int, family: str, params: Sequence[float], total: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and Hessian in (log shapes, loc, log scale)."""
    name, _ = KERNELS[family]
    *shape, _, s = params
    k = len(shape)
    value, first, second = normaliser(name, shape)
    g, g1, xg1, g2, xg2, xxg2 = total[:6]
    own, pairs = total[6 : 6 + 3 * k].reshape(k, 3), total[6 + 3 * k :]
    grad, hess = np.zeros(k + 2), np.zeros((k + 2, k + 2))
    grad[k:] = -g1 / s, -n - xg1
    hess[k, k], hess[k, k + 1], hess[k + 1, k + 1] = g2 / (s * s), (g1 + xg2) / s, xg1 + xxg2
    theta = np.array(shape)
    at = iter(pairs)
    for i in range(k):
        raw = own[i, 0] + n * first[i]
        grad[i] = theta[i] * raw
        hess[i, k], hess[i, k + 1] = -theta[i] * own[i, 1] / s, -theta[i] * own[i, 2]
        for j in range(i, k):
            hess[i, j] = theta[i] * theta[j] * (next(at) + n * second[i, j]) + (theta[i] * raw if i == j else 0.0)
    upper = np.triu(hess)
    return g + n * (value - math.log(s)), grad, upper + np.triu(upper, 1).T


@dataclass
class Fit:
    """A running fit: the best place so far, and the trial that is to be evaluated."""

    family: str
    place: np.ndarray
    n: float
    low: float
    high: float
    value: float = -math.inf
    grad: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hess: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    damp: float = 1e-3
    trial: np.ndarray | None = None
    done: bool = False
    settling: int = 0

    @property
    def params(self) -> tuple[float, ...]:
        *shape, loc, scale = natural(self.place)
        return (*shape, KERNELS[self.family][1] * loc, scale)


def natural(place: np.ndarray) -> tuple[float, ...]:
    """(shapes..., loc, scale) of (log shapes, loc, log scale); of mirrored values for mirrored families."""
    return (*map(float, np.exp(place[:-2])), float(place[-2]), float(math.exp(place[-1])))


def edge(family: str, low: float, high: float) -> float:
    """The largest location, of mirrored values for mirrored families."""
    name, sign = KERNELS[family]
    if name not in ("weibull", "gamma", "beta"):
        return math.inf
    return min(sign * low, sign * high) - MARGIN * (high - low)


def feasible(family: str, place: np.ndarray, low: float, high: float) -> bool:
    name, _ = KERNELS[family]
    if not np.isfinite(place).all() or abs(place[-1]) > 50 or (len(place) > 2 and np.abs(place[:-2]).max() > 14):
        return False
    if not place[-2] <= edge(family, low, high):
        return False
    return name != "beta" or place[-2] + math.exp(place[-1]) >= high + MARGIN * (high - low)


def settle(fit: Fit) -> None:
    """Near the maximum, where gains no longer show, the next trial is a plain Newton step; the fit is done after the last.

    Without a maximum inside of the bounds, as where a fit runs towards another family's limit, it is done at once.
    """
    fit.settling, fit.done = fit.settling + 1, True
    if fit.settling > SETTLING:
        return
    try:
        np.linalg.cholesky(-fit.hess)
        step = np.linalg.solve(-fit.hess, fit.grad)
    except np.linalg.LinAlgError:
        return
    unit = np.ones(len(step))
    unit[-2] = math.exp(fit.place[-1])
    size = float(np.abs(step / unit).max())
    if SETTLED < size < 0.01 and feasible(fit.family, fit.place + step, fit.low, fit.high):
        fit.trial, fit.done = fit.place + step, False


def propose(fit: Fit) -> None:
    """The next trial: a Newton step, damped until it ascends and stays feasible."""
    low, high = fit.low, fit.high
    scale = np.maximum(np.abs(np.diag(fit.hess)), 1e-12)
    for _ in range(60):
        a = -fit.hess + fit.damp * np.diag(scale)
        try:
            np.linalg.cholesky(a)
            step = np.linalg.solve(a, fit.grad)
            at = len(step) - 2
            room = edge(fit.family, low, high) - fit.place[at]
            if step[at] > room:  # the location stops at its bound, and the rest steps as if it had been moved there
                rest = np.delete(np.arange(len(step)), at)
                step[at] = max(room, 0.0)
                step[rest] = np.linalg.solve(a[np.ix_(rest, rest)], fit.grad[rest] - a[rest, at] * step[at])
        except np.linalg.LinAlgError:
            fit.damp = max(4 * fit.damp, 1e-6)
            continue
        step = step * min(1.0, 2.0 / max(1e-300, np.abs(np.delete(step, at)).max()))  # factors of at most e^2
        if float(fit.grad @ step - 0.5 * step @ a @ step) < GAIN * (1 + abs(fit.value)) * 1e-3:
            settle(fit)
            return
        for _ in range(40):
            if feasible(fit.family, fit.place + step, low, high):
                fit.trial = fit.place + step
                return
            step = step / 2
        fit.damp = max(4 * fit.damp, 1e-6)
    fit.done = True


Evaluate = Callable[[list[Fit]], list[np.ndarray]]


def started(family: str, params: Sequence[float], n: float, low: float, high: float) -> Fit | None:
    """A fit to begin at parameters, of ``n`` values (or their weight) between low and high; None outside of the support."""
    *shape, loc, scale = params
    place = np.array([*np.log(shape), KERNELS[family][1] * loc, math.log(scale)])
    return Fit(family, place, n, low, high, trial=place) if feasible(family, place, low, high) else None


def ascend(fits: list[Fit], evaluate: Evaluate, steps: int = STEPS) -> None:
    """Takes the fits to their maxima; ``evaluate`` gives each fit's sums at its trial."""
    for _ in range(steps):
        live = [f for f in fits if not f.done]
        if not live:
            break
        for f, total in zip(live, evaluate(live)):
            value, grad, hess = derivatives(f.n, f.family, natural(f.trial), total)
            if math.isfinite(value) and np.isfinite(grad).all() and np.isfinite(hess).all() and value > f.value - 1e-13 * abs(value):
                gain = value - f.value
                f.place, f.value, f.grad, f.hess, f.damp = f.trial, value, grad, hess, f.damp / 8 if f.damp > 1e-9 else 0.0
                if f.settling or gain < GAIN * (1 + abs(value)):
                    settle(f)
                    continue
            elif f.settling or f.value == -math.inf:
                f.done = True
                continue
            else:
                f.damp = max(8 * f.damp, 1e-6)
            propose(f)


def climb(n: int, low: float, high: float, begin: Sequence[tuple[str, tuple[float, ...]]], evaluate: Evaluate, steps: int = STEPS) -> dict[str, tuple[tuple[float, ...], float]]:
    """The best fit of each family, as (parameters, log-likelihood), from starts of (family, parameters)."""
    fits = [f for f in (started(family, p, n, low, high) for family, p in begin) if f]
    ascend(fits, evaluate, steps)
    out: dict[str, tuple[tuple[float, ...], float]] = {}
    for f in fits:
        if math.isfinite(f.value) and (f.family not in out or f.value > out[f.family][1]):
            out[f.family] = f.params, f.value
    return out


def over_array(z: np.ndarray, part: int = 1 << 16):
    """Sums over an array, whose terms are held for a part of it at a time."""
    return lambda fits: [sum(sums(z[s : s + part], f.family, natural(f.trial)) for s in range(0, len(z), part)) for f in fits]


def over_rows(rows: DataFrame, column: str):
    """Sums over all rows: a task adds up its batches for all fits, and tasks' sums meet by fit."""
    schema = "fit int, sums array<double>"

    def evaluate(live: list[Fit]) -> list[np.ndarray]:
        fits = [(f.family, natural(f.trial)) for f in live]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total: list = [0.0] * len(fits)
            for b in batches:
                z = b.column(column).to_numpy(zero_copy_only=False)
                if len(z):
                    total = [t + sums(z, *f) for t, f in zip(total, fits)]
            if any(isinstance(t, np.ndarray) for t in total):
                yield pa.record_batch({"fit": pa.array(range(len(fits)), pa.int32()), "sums": pa.array([t.tolist() for t in total], pa.list_(pa.float64()))})

        def add(t: pa.Table) -> pa.Table:
            total = np.sum([np.asarray(x.values) for x in t.column("sums")], axis=0)
            return pa.table({"fit": t.column("fit").slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})

        found = {r["fit"]: np.array(r["sums"]) for r in rows.select(column).mapInArrow(run, schema).groupBy("fit").applyInArrow(add, schema).collect()}
        return [found[i] for i in range(len(fits))]

    return evaluate
