"""Gaussian-process mean models for up to 1000 rows, with leave-one-out calibration."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_ROWS = 1000
KERNELS = ("Matern32", "Matern52", "RBF", "RationalQuadratic")
#: Fixed bounds of the constant, of the length scales and of the rational quadratic's shape.
CONSTANT, LENGTH, SHAPE = (1e-5, 1e6), (1e-3, 1e5), (1e-5, 1e5)
STEPS = 100
NOISE = 0.01


def correlation(kind: str, a: np.ndarray, b: np.ndarray, scales: np.ndarray, shape: float = 1.0) -> np.ndarray:
    d2 = np.maximum((((a[:, None, :] - b[None, :, :]) / scales) ** 2).sum(2), 0)
    if kind == "RBF":
        return np.exp(-0.5 * d2)
    if kind == "RationalQuadratic":
        return (1 + d2 / (2 * shape)) ** -shape
    r = np.sqrt(d2)
    if kind == "Matern32":
        k = math.sqrt(3) * r
        return (1 + k) * np.exp(-k)
    k = math.sqrt(5) * r
    return (1 + k + k * k / 3) * np.exp(-k)


@dataclass
class KrigingModel:
    inputs: tuple[str, ...]
    kernel: str
    constant: float
    scales: np.ndarray
    shape: float
    noise: float
    X: np.ndarray
    weights: np.ndarray
    gamma: float = 1.0
    loo_residuals: np.ndarray | None = None
    cv_scores: dict = field(default_factory=dict)
    kind: str = "Kriging"
    degree: None = None

    @property
    def key(self) -> tuple[str, None]:
        return ("Kriging", None)

    @property
    def terms(self) -> list:
        return []

    def predict(self, X: np.ndarray) -> np.ndarray:
        X = np.asarray(X, float).reshape(-1, len(self.inputs))
        out = np.empty(len(X))
        for s in range(0, len(X), 4096):
            out[s : s + 4096] = self.constant * correlation(self.kernel, X[s : s + 4096], self.X, self.scales, self.shape) @ self.weights
        return out


def unpack(p: np.ndarray, kernel: str, d: int) -> tuple[float, np.ndarray, float]:
    """Constant, length scales and shape from logarithms, clipped to their bounds.

    The rational quadratic kernel has one length scale for all inputs.
    """
    c = float(np.clip(math.exp(np.clip(p[0], -30, 30)), *CONSTANT))
    if kernel == "RationalQuadratic":
        return c, np.full(d, np.clip(math.exp(np.clip(p[1], -30, 30)), *LENGTH)), float(np.clip(math.exp(np.clip(p[2], -30, 30)), *SHAPE))
    return c, np.clip(np.exp(np.clip(p[1 : 1 + d], -30, 30)), *LENGTH), 1.0


def slopes(kind: str, c: float, d2: np.ndarray, parts: list[np.ndarray], shape: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The kernel and its derivatives by the logarithms of its parameters.

    ``parts`` are the scaled squared differences of each input, which add up to ``d2``.
    """
    if kind == "RBF":
        R = np.exp(-0.5 * d2)
        each = [R * x for x in parts]
    elif kind == "RationalQuadratic":
        base = 1 + d2 / (2 * shape)
        R = base**-shape
        each = [d2 * R / base, shape * R * (d2 / (2 * shape * base) - np.log(base))]
    elif kind == "Matern32":
        k = np.sqrt(3 * d2)
        e = np.exp(-k)
        R = (1 + k) * e
        each = [3 * e * x for x in parts]
    else:
        k = np.sqrt(5 * d2)
        e = np.exp(-k)
        R = (1 + k + k * k / 3) * e
        each = [5 / 3 * (1 + k) * e * x for x in parts]
    return c * R, [c * R, *[c * x for x in each]]


def negative_evidence(p: np.ndarray, kernel: str, X: np.ndarray, y: np.ndarray, noise: float) -> tuple[float, np.ndarray]:
    """The negative log evidence, but for a constant, and its gradient."""
    c, scales, shape = unpack(p, kernel, X.shape[1])
    parts = [((X[:, None, k] - X[None, :, k]) / scales[k]) ** 2 for k in range(X.shape[1])]
    K, each = slopes(kernel, c, sum(parts), parts, shape)
    try:
        low = np.linalg.cholesky(K + noise * np.eye(len(X)))
    except np.linalg.LinAlgError:
        return math.inf, np.zeros(len(p))
    half = np.linalg.solve(low, np.eye(len(X)))
    inverse = half.T @ half
    a = inverse @ y
    inner = inverse - np.outer(a, a)
    return float(0.5 * y @ a + np.log(np.diag(low)).sum()), 0.5 * np.array([(inner * x).sum() for x in each])


def descend(f, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Quasi-Newton steps within bounds: parameters at a bound that would leave it are held there."""
    x = np.clip(start, low, high)
    value, grad = f(x)
    B = np.eye(len(x))
    for _ in range(steps):
        free = ~((x <= low) & (grad > 0) | (x >= high) & (grad < 0))
        if not math.isfinite(value) or not free.any() or np.abs(grad[free]).max() < 1e-6:
            break
        step = np.zeros(len(x))
        step[free] = -B[np.ix_(free, free)] @ grad[free]
        if step @ grad >= 0:
            B, step = np.eye(len(x)), np.where(free, -grad, 0.0)
        step *= min(1.0, 2.0 / np.abs(step).max())
        for _ in range(25):
            to = np.clip(x + step, low, high)
            v, g = f(to)
            if v <= value + 1e-4 * grad @ (to - x):
                break
            step = step / 2
        else:
            break
        s, t, gain = to - x, g - grad, value - v
        x, value, grad = to, v, g
        if s @ t > 1e-12:
            rho = 1 / (s @ t)
            left = np.eye(len(x)) - rho * np.outer(s, t)
            B = left @ B @ left.T + rho * np.outer(s, s)
        if gain < 1e-10 * (1 + abs(value)):
            break
    return x, value


def build(X: np.ndarray, y: np.ndarray, inputs: Sequence[str], kernel: str, p: np.ndarray, noise: float) -> KrigingModel:
    c, scales, shape = unpack(p, kernel, X.shape[1])
    K = c * correlation(kernel, X, X, scales, shape) + noise * np.eye(len(X))
    return KrigingModel(tuple(inputs), kernel, c, scales, shape, noise, X, np.linalg.solve(K, y))


def starting(X: np.ndarray, y: np.ndarray, kernel: str, restart: int, seed: int = 42) -> np.ndarray:
    """Logarithms to begin with: of the data's scales, and for restarts a keyed draw around them."""
    own = np.log([max(float(np.var(y) + y.mean() ** 2), 1e-5)])
    spread = np.log(np.maximum(X.std(0), 1e-3))
    first = np.concatenate([own, [spread.mean(), 0.0]]) if kernel == "RationalQuadratic" else np.concatenate([own, spread])
    return first if not restart else first + np.random.default_rng([seed, restart]).normal(0, 1.5, len(first))


def climb(X: np.ndarray, y: np.ndarray, kernel: str, restart: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(logarithms, negative evidence) that one start leads to."""
    noise, lengths = max(NOISE * float(np.var(y)), 1e-12), 1 if kernel == "RationalQuadratic" else X.shape[1]
    bounds = np.log([CONSTANT, *[LENGTH] * lengths, *[SHAPE] * (kernel == "RationalQuadratic")])
    return descend(lambda p: negative_evidence(p, kernel, X, y, noise), starting(X, y, kernel, restart), *bounds.T, steps)


def fit(X: np.ndarray, y: np.ndarray, inputs: Sequence[str], kernel: str, restarts: int = 5) -> tuple[KrigingModel, np.ndarray]:
    """The most likely hyperparameters from a data-scaled start and keyed restarts."""
    p, _ = min((climb(X, y, kernel, k) for k in range(1 + restarts)), key=lambda x: x[1])
    return build(X, y, inputs, kernel, p, max(NOISE * float(np.var(y)), 1e-12)), p


def refit(spec: tuple, X: np.ndarray, y: np.ndarray, inputs: Sequence[str]) -> KrigingModel:
    """New data with known hyperparameters: spec is (kernel, logarithms)."""
    kernel, p = spec
    return build(X, y, inputs, kernel, np.asarray(p), max(NOISE * float(np.var(y)), 1e-12))


def loo_residuals(model: KrigingModel, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(standardised leave-one-out residuals, gamma) from one inverse of the system with a constant mean."""
    n = len(y)
    K = np.zeros((n + 1, n + 1))
    K[:n, :n] = model.constant * correlation(model.kernel, model.X, model.X, model.scales, model.shape) + model.noise * np.eye(n)
    K[:n, n] = K[n, :n] = 1
    try:
        B = np.linalg.inv(K)[:n, :n]
    except np.linalg.LinAlgError:
        mean, std = y, np.full(n, float(np.std(y)) or 1.0)
    else:
        diag = np.where(np.abs(np.diag(B)) < 1e-12, 1e-12, np.diag(B))
        mean = -(B @ y - np.diag(B) * y) / diag
        std = np.sqrt(np.maximum(1e-10, 1 / diag))
    e = (y - mean) / std
    return e, max(1.0, float(np.max(np.abs(e))) / 3)


def fit_kriging(df: DataFrame, inputs: Sequence[str], outcome: str, folds: int = 10, restarts: int = 10, cv_restarts: int = 5) -> tuple[KrigingModel, float, tuple] | None:
    """(model, cross-validation MSE, refit spec) of the best kernel; None for more than MOST_ROWS rows.

    Each kernel, fold and start is a task of its own, and so is each start of the last fit; the rows, at
    most MOST_ROWS, are broadcast.
    """
    rows = df.select(*inputs, outcome).limit(MOST_ROWS + 1).toPandas()
    if len(rows) > MOST_ROWS or len(rows) < 3:
        return None
    rows = rows.sort_values(rows.columns.tolist())
    X, y = rows[list(inputs)].to_numpy(float), rows[outcome].to_numpy(float)
    k = min(folds, len(y))
    fold = np.random.RandomState(42).permutation(len(y)) % k
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((X, y, fold))

    def fitted(tasks: list[tuple[str, int, int]]) -> list:
        """(kernel, fold, value, mse, logarithms) of starts; the fold -1 holds nothing back."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            X, y, fold = shared.value
            for b in batches:
                for t in b.column("id").to_pylist():
                    kernel, f, restart = tasks[t]
                    A, v = X[fold != f], y[fold != f]
                    p, value = climb(A, v, kernel, restart)
                    if not math.isfinite(value):
                        continue
                    m = build(A, v, ["x"] * X.shape[1], kernel, p, max(NOISE * float(np.var(v)), 1e-12))
                    mse = float(np.mean((y[fold == f] - m.predict(X[fold == f])) ** 2)) if f >= 0 else 0.0
                    yield pa.record_batch({"kernel": pa.array([kernel]), "fold": pa.array([f], pa.int32()), "value": pa.array([value]), "mse": pa.array([mse]), "p": pa.array([p], pa.list_(pa.float64()))})

        parts = max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism))
        return spark.range(0, len(tasks), numPartitions=parts).mapInArrow(run, "kernel string, fold int, value double, mse double, p array<double>").collect()

    held: dict[tuple[str, int], tuple[float, float]] = {}
    for r in fitted([(x, f, i) for x in KERNELS for f in range(k) for i in range(1 + cv_restarts)]):
        at = (r["kernel"], r["fold"])
        held[at] = min(held.get(at, (math.inf, math.inf)), (r["value"], r["mse"]))
    if not held:
        return None
    by = {x: float(np.mean([m for (y, _), (_, m) in held.items() if y == x])) for x in {x for x, _ in held}}
    best = min((x for x in KERNELS if x in by), key=by.get)
    starts = fitted([(best, -1, i) for i in range(1 + restarts)])
    if not starts:
        return None
    p = np.array(min(starts, key=lambda r: r["value"])["p"])
    model = build(X, y, inputs, best, p, max(NOISE * float(np.var(y)), 1e-12))
    model.loo_residuals, model.gamma = loo_residuals(model, y)
    return model, by[best], (best, tuple(p))
