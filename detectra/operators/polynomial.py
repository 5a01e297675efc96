"""Ridge polynomial mean models from one aggregation.

All sums that any degree and any cross-validation fold needs are sums of monomials of the
standardised inputs, so one pass gives every model and every fold's error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..sources import checkpoint

ALPHA = 0.1
DEGREES = range(1, 11)
FOLDS = 10
#: Degrees of more terms are fitted by conjugate gradients, whose steps are passes over the rows; and beyond
#: this many sums the Gram matrix of the others is added up in Arrow batches.
MOST_TERMS = 3100
NATIVE_SUMS = 150
#: Conjugate gradients: residual at which a system is solved, steps at most, numbers of features expanded at a time.
RESIDUAL, STEPS, CELLS = 1e-10, 500, 1 << 22


def exponents(d: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of all terms up to a degree: the constant, then degree by degree in input order."""
    out = []
    for k in range(degree + 1):
        for c in combinations_with_replacement(range(d), k):
            out.append(tuple(c.count(i) for i in range(d)))
    return out


@dataclass
class PolynomialModel:
    """Coefficients belong to standardised features of standardised inputs."""

    inputs: tuple[str, ...]
    degree: int
    center: np.ndarray
    spread: np.ndarray
    terms: list[tuple[int, ...]]
    term_mean: np.ndarray
    term_std: np.ndarray
    coef: np.ndarray
    intercept: float
    cv_scores: dict = field(default_factory=dict)
    kind: str = "Polynomial"
    gamma: float = 1.0

    @property
    def key(self) -> tuple[str, int]:
        return ("Polynomial", self.degree)

    def features(self, X: np.ndarray) -> np.ndarray:
        z = (np.asarray(X, float).reshape(-1, len(self.inputs)) - self.center) / self.spread
        return np.stack([np.prod([z[:, i] ** e for i, e in enumerate(t) if e] or [np.ones(len(z))], axis=0) for t in self.terms], 1)

    def predict(self, X: np.ndarray) -> np.ndarray:
        return (self.features(X) - self.term_mean) / self.term_std @ self.coef + self.intercept

    def flat(self) -> tuple[np.ndarray, float]:
        """Coefficients of the plain monomials of standardised inputs, and the constant."""
        c = self.coef / self.term_std
        return c, self.intercept - float(c @ self.term_mean)

    def column(self, at: dict[str, Column] | None = None) -> Column:
        """The prediction as a Column."""
        at = at or {c: F.col(f"`{c}`") for c in self.inputs}
        z = [(at[c] - float(m)) / float(s) for c, m, s in zip(self.inputs, self.center, self.spread)]
        c, out = self.flat()
        total = F.lit(float(out))
        for k, t in zip(c, self.terms):
            if any(t) and k:
                term = F.lit(float(k))
                for v, e in zip(z, t):
                    for _ in range(e):
                        term = term * v
                total = total + term
        return total

    def raw(self) -> dict[tuple[int, ...], float]:
        """Coefficients of monomials of the raw inputs, which reproduce predictions as they are."""
        c, const = self.flat()
        out: dict[tuple[int, ...], float] = {}
        d = len(self.inputs)
        for k, t in zip([*c, const], [*self.terms, (0,) * d]):
            if not any(t) and k is not const:
                continue
            parts = {(0,) * d: float(k)}
            for i, e in enumerate(t):
                grown: dict[tuple[int, ...], float] = {}
                for u, v in parts.items():
                    for j in range(e + 1):
                        w = tuple(x + j * (n == i) for n, x in enumerate(u))
                        grown[w] = grown.get(w, 0.0) + v * math.comb(e, j) * (-self.center[i]) ** (e - j) / self.spread[i] ** e
                parts = grown
            for u, v in parts.items():
                out[u] = out.get(u, 0.0) + v
        return out


def equation(model, outcome: str = "y", raw: bool = False) -> str:
    """LaTeX of a polynomial; coefficients of standardised features, or with ``raw`` of the raw inputs."""
    if model.kind != "Polynomial":
        return "Equation not available for Kriging models (Gaussian Process)."
    if raw:
        coefs = model.raw()
        pairs, const = [(t, v) for t, v in coefs.items() if any(t)], coefs.get((0,) * len(model.inputs), 0.0)
    else:
        pairs, const = [(t, v) for t, v in zip(model.terms, model.coef) if any(t)], model.intercept
    escape = lambda s: s.replace("_", r"\_")
    text = f"{escape(outcome)} = {const:.4g}"
    for t, v in pairs:
        if abs(v) >= 1e-7:
            name = r" \cdot ".join(escape(c) + (f"^{{{e}}}" if e > 1 else "") for c, e in zip(model.inputs, t) if e)
            text += f" {'+' if v > 0 else '-'} {abs(v):.4g} \\cdot {name}"
    return re.sub(r"\s+", " ", text)


class Moments:
    """Sums of monomials, of monomials times the outcome, and of its square, for each fold."""

    def __init__(self, d: int, degree: int, folds: dict[int, tuple[dict, dict, float]]):
        self.d, self.degree, self.folds = d, degree, folds

    def total(self, without: int | None = None) -> tuple[dict, dict, float]:
        own = [v for k, v in self.folds.items() if k != without]
        add = lambda i: {t: math.fsum(v[i][t] for v in own) for t in own[0][i]}
        return add(0), add(1), math.fsum(v[2] for v in own)


def standardisation(df: DataFrame, inputs: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    aggs = [f(F.col(f"`{c}`").cast("double")) for c in inputs for f in (F.avg, F.stddev_pop)]
    n, *v = df.agg(F.count(F.lit(1)), *aggs).first()
    center, spread = np.array(v[::2], float), np.array(v[1::2], float)
    return n, center, np.where(spread > 0, spread, 1.0)


def moments(df: DataFrame, inputs: Sequence[str], outcome: str, degree: int, fold: Column, center: np.ndarray, spread: np.ndarray) -> Moments:
    d = len(inputs)
    twice, once = exponents(d, 2 * degree), exponents(d, degree)
    z = df.select(*[((F.col(f"`{c}`").cast("double") - float(m)) / float(s)).alias(f"z{i}") for i, (c, m, s) in enumerate(zip(inputs, center, spread))], F.col(f"`{outcome}`").cast("double").alias("y"), fold.cast("int").alias("fold"))
    if len(twice) + len(once) <= NATIVE_SUMS:
        powers = z.select("y", "fold", *[F.col(f"z{i}").alias(f"p{i}_1") for i in range(d)])
        for e in range(2, 2 * degree + 1):
            powers = powers.withColumns({f"p{i}_{e}": F.col(f"p{i}_{e - 1}") * F.col(f"p{i}_1") for i in range(d)})
        term = lambda t: math.prod((F.col(f"p{i}_{e}") for i, e in enumerate(t) if e), start=F.lit(1.0))
        rows = powers.groupBy("fold").agg(*[F.sum(term(t)).alias(f"m{k}") for k, t in enumerate(twice)], *[F.sum(term(t) * F.col("y")).alias(f"b{k}") for k, t in enumerate(once)], F.sum(F.col("y") * F.col("y")).alias("yy")).collect()
        return Moments(d, degree, {r["fold"]: ({t: r[f"m{k}"] for k, t in enumerate(twice)}, {t: r[f"b{k}"] for k, t in enumerate(once)}, r["yy"]) for r in rows})

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            x = np.stack([np.asarray(b.column(f"z{i}")) for i in range(d)], 1)
            y, f = np.asarray(b.column("y")), np.asarray(b.column("fold"))
            for k in np.unique(f).tolist():
                v, w = x[f == k], y[f == k]
                p = [[np.ones(len(v))] for _ in range(d)]
                for i in range(d):
                    for _ in range(2 * degree):
                        p[i].append(p[i][-1] * v[:, i])
                get = lambda t: math.prod((p[i][e] for i, e in enumerate(t) if e), start=p[0][0])  # noqa: E731, B023
                new = np.concatenate([[get(t).sum() for t in twice], [get(t) @ w for t in once], [w @ w]])
                sums[k] = sums[k] + new if k in sums else new
        for k, v in sums.items():
            yield pa.record_batch({"fold": pa.array([k], pa.int32()), "sums": pa.array([v], pa.list_(pa.float64()))})

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x.values) for x in t.column("sums")], axis=0)
        return pa.table({"fold": t.column("fold").slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "fold int, sums array<double>"
    rows = z.mapInArrow(partial, schema).groupBy("fold").applyInArrow(add, schema).collect()
    a, b = len(twice), len(once)
    return Moments(d, degree, {r["fold"]: (dict(zip(twice, r["sums"][:a])), dict(zip(once, r["sums"][a : a + b])), r["sums"][-1]) for r in rows})


def codes(terms: Iterable[tuple[int, ...]], base: int) -> np.ndarray:
    """Numbers of exponents whose sums are the numbers of products."""
    t = np.array(list(terms), np.int64)
    return t @ (base ** np.arange(t.shape[1], dtype=np.int64)) if len(t) else np.zeros(0, np.int64)


def products_of(m: dict, terms: list[tuple[int, ...]]) -> np.ndarray:
    """The sums of all products of two terms."""
    base = 1 + max(max(t) for t in m)
    keys = codes(m, base)
    order = np.argsort(keys)
    keys, values, own = keys[order], np.fromiter(m.values(), float, len(m))[order], codes(terms, base)
    out = np.empty((len(terms), len(terms)))
    for s in range(0, len(terms), 256):
        out[s : s + 256] = values[np.searchsorted(keys, own[s : s + 256, None] + own[None, :])]
    return out


def solve(sums: tuple[dict, dict, float], terms: list[tuple[int, ...]], alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(term means, term stds, coefficients, intercept) of a ridge on standardised terms."""
    m, b, _ = sums
    d = len(terms[0])
    zero = (0,) * d
    n = m[zero]
    mean = np.array([m[t] / n for t in terms])
    second = products_of(m, terms)
    cov = second / n - np.outer(mean, mean)
    var = np.maximum(np.diag(cov), 0)
    std = np.where(var > 1e-20, np.sqrt(var), 1.0)
    ybar = b[zero] / n
    rhs = (np.array([b[t] / n for t in terms]) - mean * ybar) / std
    gram = cov / np.outer(std, std) + np.eye(len(terms)) * alpha / n
    live = var > 1e-20
    coef = np.zeros(len(terms))
    if live.any():
        g, r = gram[np.ix_(live, live)], rhs[live]
        try:
            coef[live] = np.linalg.solve(g, r) if alpha else np.linalg.lstsq(g, r, rcond=1e-12)[0]
        except np.linalg.LinAlgError:
            coef[live] = np.linalg.lstsq(g, r, rcond=1e-12)[0]
    return mean, std, coef, ybar


def squared_error(sums: tuple[dict, dict, float], terms: list[tuple[int, ...]], fit: tuple) -> tuple[float, float]:
    """SSE and SST of a fit on other sums."""
    m, b, yy = sums
    mean, std, coef, intercept = fit
    zero = (0,) * len(terms[0])
    c = coef / std
    const = intercept - c @ mean
    full, weights = [*terms, zero], np.append(c, const)
    gram = products_of(m, full)
    sse = yy - 2 * weights @ np.array([b[t] for t in full]) + weights @ gram @ weights
    return max(float(sse), 0.0), float(yy - b[zero] ** 2 / m[zero])


def hash_fold(row_id: Column, k: int, seed: int = 42) -> Column:
    """A fold that is a function of the row's id, so that any partitioning gives the same folds."""
    return draws.index(k, F.lit(seed), row_id)


def row_key(df: DataFrame, inputs: Sequence[str], outcome: str, row_id: str | None) -> Column:
    return F.col(f"`{row_id}`") if row_id else F.xxhash64(*[F.col(f"`{c}`") for c in [*inputs, outcome]])


@dataclass
class PolynomialFits:
    models: dict[tuple[str, int], PolynomialModel]
    cv_mse: dict[tuple[str, int], float]
    cv_r2: dict[tuple[str, int], float]

    @property
    def winner(self) -> tuple[str, int]:
        return min(self.cv_mse, key=self.cv_mse.get)


def fits_from(sums: Moments, inputs: Sequence[str], degrees: Sequence[int], center: np.ndarray, spread: np.ndarray, alpha: float = ALPHA) -> PolynomialFits:
    """Models of the degrees, with their mean per-fold errors, from sums of monomials of standardised inputs."""
    d = len(inputs)
    models, mse, r2 = {}, {}, {}
    for k in degrees:
        terms = exponents(d, k)
        errors, scores = [], []
        for f, own in sums.folds.items():
            if len(sums.folds) < 2:
                continue
            sse, sst = squared_error(own, terms, solve(sums.total(without=f), terms, alpha))
            size = own[0][(0,) * d]
            errors.append(sse / size)
            scores.append(1 - sse / sst if sst > 0 else (1.0 if sse == 0 else 0.0))
        key = ("Polynomial", k)
        mse[key], r2[key] = float(np.mean(errors)) if errors else math.inf, float(np.mean(scores)) if scores else 0.0
        mean, std, coef, intercept = solve(sums.total(), terms, alpha)
        models[key] = PolynomialModel(tuple(inputs), k, center, spread, terms, mean, std, coef, float(intercept))
    for m in models.values():
        m.cv_scores = mse
    return PolynomialFits(models, mse, r2)


def fit_polynomials(df: DataFrame, inputs: Sequence[str], outcome: str, degrees: Iterable[int] = DEGREES, folds: int = FOLDS, alpha: float = ALPHA, row_id: str | None = None) -> PolynomialFits:
    """Models of all degrees with their mean per-fold errors; ties go to the lower degree."""
    d, degrees = len(inputs), list(degrees)
    _, center, spread = standardisation(df, inputs)
    fold = hash_fold(row_key(df, inputs, outcome, row_id), folds)
    dense = [k for k in degrees if math.comb(d + k, d) <= MOST_TERMS]
    found = PolynomialFits({}, {}, {})
    if dense:
        found = fits_from(moments(df, inputs, outcome, max(dense), fold, center, spread), inputs, dense, center, spread, alpha)
    for k in degrees:
        if k not in dense:
            key = ("Polynomial", k)
            found.models[key], found.cv_mse[key], found.cv_r2[key] = conjugate_fit(df, inputs, outcome, k, fold, center, spread, alpha)
            found.models[key].cv_scores = found.cv_mse
    return found


def powers(z: np.ndarray, terms: list[tuple[int, ...]]) -> np.ndarray:
    """Rows x terms of monomials; each is a lower one times an input."""
    at = {t: i for i, t in enumerate(terms)}
    out = np.empty((len(terms), len(z)))
    for i, t in enumerate(terms):
        k = next((k for k, e in enumerate(t) if e), None)
        out[i] = 1.0 if k is None else out[at[tuple(e - (j == k) for j, e in enumerate(t))]] * z[:, k]
    return out.T


def conjugate_fit(df: DataFrame, inputs: Sequence[str], outcome: str, degree: int, fold: Column, center: np.ndarray, spread: np.ndarray, alpha: float) -> tuple[PolynomialModel, float, float]:
    """(model, mean fold MSE, mean fold R2) of a degree with any number of terms.

    The ridge systems of all rows and of all rows but a fold's are solved at once by conjugate
    gradients.  No Gram matrix is formed: a step is a pass in which tasks expand some rows at a time and
    send A'(A v), of terms x systems.  On standardised terms the diagonal is 1 + alpha / n for all, so
    standardising is the preconditioning by the diagonal.
    """
    d, terms = len(inputs), exponents(len(inputs), degree)
    names, step = [f"z{i}" for i in range(d)], max(1, CELLS // len(terms))
    z = df.select(*[((F.col(f"`{c}`").cast("double") - float(m)) / float(s)).alias(n) for n, c, m, s in zip(names, inputs, center, spread)], F.col(f"`{outcome}`").cast("double").alias("y"), fold.cast("int").alias("fold"))
    z = checkpoint.cut(z)
    folds = sorted(r[0] for r in z.select("fold").distinct().collect())
    held = folds if len(folds) > 1 else []
    systems = len(held) + 1  # the last is of all rows

    def taught(f: np.ndarray) -> np.ndarray:
        """Rows x systems: does a row belong to a system?"""
        return np.stack([*[f != k for k in held], np.ones(len(f), bool)], 1).astype(float)

    def passed(f, size: int) -> np.ndarray:
        """The sum over all rows of f(features, outcome, fold)."""
        schema = "place int, body binary"

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            total, some = np.zeros(size), False
            for b in batches:
                for s in range(0, b.num_rows, step):
                    part = b.slice(s, step)
                    total, some = total + f(powers(np.stack([np.asarray(part.column(c)) for c in names], 1), terms), np.asarray(part.column("y")), np.asarray(part.column("fold"))), True
            if some:
                yield pa.record_batch({"place": pa.array([TaskContext.get().partitionId()], pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer()) for x in t.sort_by("place").column("body"))
            return pa.table({"place": t.column("place").slice(0, 1), "body": pa.array([total.tobytes()], pa.binary())})

        parts = z.mapInArrow(partial, schema).groupBy((F.col("place") % 64).alias("part")).applyInArrow(add, schema)
        return sum((np.frombuffer(r["body"]) for r in sorted(parts.collect())), np.zeros(size))

    t = len(terms)

    def first(a: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        own = taught(f)
        return np.concatenate([(a.T @ own).ravel(), ((a * a).T @ own).ravel(), (a.T @ (own * y[:, None])).ravel(), own.sum(0), own.T @ y])

    raw = passed(first, 3 * t * systems + 2 * systems)
    one, two, cross = raw[: 3 * t * systems].reshape(3, t, systems)
    n, ybar = raw[3 * t * systems : -systems], raw[-systems:] / np.maximum(raw[3 * t * systems : -systems], 1)
    mean = one / n
    var = np.maximum(two / n - mean**2, 0)
    live = var > 1e-20
    std = np.where(live, np.sqrt(var), 1.0)
    rhs = np.where(live, (cross / n - mean * ybar) / std, 0.0)

    def times(v: np.ndarray) -> np.ndarray:
        u = v / std
        shift = (mean * u).sum(0)

        def product(a: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
            w = (a @ u - shift) * taught(f)
            return np.concatenate([(a.T @ w).ravel(), w.sum(0)])

        got = passed(product, t * systems + systems)
        both = got[: t * systems].reshape(t, systems) - mean * got[t * systems :]
        return np.where(live, both / std / n + v * (alpha / n), 0.0)

    coef, r = np.zeros((t, systems)), rhs.copy()
    p, size = r.copy(), (r * r).sum(0)
    goal = RESIDUAL**2 * np.maximum(size, 1e-300)
    for _ in range(min(STEPS, 4 * t)):
        if (size <= goal).all():
            break
        q = times(p)
        move = np.where(size > goal, size / np.maximum((p * q).sum(0), 1e-300), 0.0)
        coef, r = coef + move * p, r - move * q
        new = (r * r).sum(0)
        p, size = r + np.where(size > goal, new / np.maximum(size, 1e-300), 0.0) * p, new
    flat = coef / std
    const = ybar - (mean * flat).sum(0)

    def errors(a: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        out = np.zeros((len(held), 4))
        for i, k in enumerate(held):
            own = f == k
            e = y[own] - a[own] @ flat[:, i] - const[i]
            out[i] = own.sum(), e @ e, y[own].sum(), y[own] @ y[own]
        return out.ravel()

    mse, r2 = math.inf, 0.0
    if held:
        count, sse, sy, yy = passed(errors, 4 * len(held)).reshape(len(held), 4).T
        sst = yy - sy**2 / count
        mse, r2 = float(np.mean(sse / count)), float(np.mean(np.where(sst > 0, 1 - sse / np.where(sst > 0, sst, 1.0), np.where(sse == 0, 1.0, 0.0))))
    model = PolynomialModel(tuple(inputs), degree, center, spread, terms, mean[:, -1], std[:, -1], coef[:, -1], float(ybar[-1]))
    return model, mse, r2


def fit_arrays(X: np.ndarray, y: np.ndarray, inputs: Sequence[str], degree: int, alpha: float = ALPHA) -> PolynomialModel:
    """The same model from arrays in memory, for resamples."""
    X = np.asarray(X, float)
    center, spread = X.mean(0), X.std(0)
    spread = np.where(spread > 0, spread, 1.0)
    m = PolynomialModel(tuple(inputs), degree, center, spread, exponents(X.shape[1], degree), np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    f = m.features(X)
    m.term_mean, std = f.mean(0), f.std(0)
    m.term_std = np.where(std > 1e-10, std, 1.0)
    g = (f - m.term_mean) / m.term_std
    m.intercept = float(np.mean(y))
    a = np.vstack([g, math.sqrt(alpha) * np.eye(g.shape[1])]) if alpha else g
    m.coef = np.linalg.lstsq(a, np.concatenate([y - m.intercept, np.zeros(len(a) - len(g))]), rcond=None)[0]
    return m


def fit_weighted(parts: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], inputs: Sequence[str], degree: int, alpha: float = ALPHA) -> PolynomialModel:
    """``fit_arrays`` of rows repeated by weight, read some times in parts of (X, y, weight); a part is all that is held."""
    first = sum(w @ np.column_stack([X, y, np.ones(len(y))]) for X, y, w in parts())
    n = first[-1]
    mean = lambda f: sum(w @ f(X, y) for X, y, w in parts()) / n
    center = first[:-2] / n
    spread = np.sqrt(mean(lambda X, y: (X - center) ** 2))
    spread = np.where(spread > 0, spread, 1.0)
    m = PolynomialModel(tuple(inputs), degree, center, spread, exponents(len(inputs), degree), np.zeros(0), np.zeros(0), np.zeros(0), 0.0)
    m.term_mean = mean(lambda X, y: m.features(X))
    std = np.sqrt(mean(lambda X, y: (m.features(X) - m.term_mean) ** 2))
    m.term_std = np.where(std > 1e-10, std, 1.0)
    m.intercept = float(first[-2] / n)
    k = len(m.term_mean)
    r = np.zeros((0, k + 1))
    for X, y, w in parts():  # triangles of the parts meet one after the other
        rows = np.column_stack([(m.features(X) - m.term_mean) / m.term_std, y - m.intercept]) * np.sqrt(w)[:, None]
        r = np.linalg.qr(np.vstack([r, rows]), mode="r")
    extra = math.sqrt(alpha) * np.eye(k) if alpha else np.zeros((0, k))
    a, b = np.vstack([r[:, :k], extra]), np.concatenate([r[:, k], np.zeros(len(extra))])
    m.coef = np.linalg.lstsq(a, b, rcond=np.finfo(float).eps * max(n + len(extra), k))[0]
    return m
