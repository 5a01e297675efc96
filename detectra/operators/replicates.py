"""Resamples over all rows, all replicates in a few passes.

Rows are packed into blocks, a table in the shared folder, and a block draws its rows' weights for a
group of replicates from a generator seeded by (seed, group, block): Poisson weights of mean 1,
whose probabilities are rounded to 2**-16.  Every pass and every retry sees the same weights, and
repeated rows have weights of their own.  A polynomial of a replicate needs weighted sums of monomials
only, so one pass fits all; tasks' sums meet in a tree, and the driver gets matrices of feature size.

``bootstrap`` makes whole PoD curves in this way: models, then the noise on a lattice, then the
parameters of the error family by weighted Newton steps, and the curves, which need no rows.
Replicates are worked through in sets whose lattices are at most ``SET_BYTES``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import checkpoint
from . import likelihood, polynomial

#: Rows of a block, replicates that draw together, bytes that a pass may add up for all of its replicates.
BLOCK, GROUP, SET_BYTES = 8192, 64, 64 << 20
#: Lattice nodes to a bandwidth at most, and nodes in all; steps of weighted fits.
NODES, MOST_NODES, STEPS = 32, 1 << 16, 25
FAN = 256


def packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(block, body): all rows of numeric columns in blocks, cut, so that all passes see the same."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                rows = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.slice(s, BLOCK).columns], 1)
                yield pa.record_batch({"block": pa.array([place], pa.int64()), "body": pa.array([rows.tobytes()], pa.binary())})
                place += 1

    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    return checkpoint.cut(rows.mapInArrow(pack, "block long, body binary"))


def weight_table() -> np.ndarray:
    p = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(np.round(p * 65536), np.arange(65536), "right").astype(np.uint8)


WEIGHTS = weight_table()


def weights(seed: int, group: int, block: int, n: int) -> np.ndarray:
    """Rows x replicates of a group."""
    return WEIGHTS[np.random.default_rng([seed, group, block]).integers(0, 65536, (n, GROUP), np.uint16)].astype(float)


def summed(blocks: DataFrame, groups: Sequence[int], f, combine=np.add) -> dict[int, np.ndarray]:
    """For each group the sum over all blocks of f(group, block, rows), by tasks and then in a tree."""
    schema, groups = "place int, key int, body binary", list(groups)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for block, body in zip(b.column("block").to_pylist(), b.column("body")):
                for g in groups:
                    own = f(g, block, np.frombuffer(body.as_buffer()))
                    held[g] = combine(held[g], own) if g in held else own
        place = TaskContext.get().partitionId()
        for g, x in held.items():
            yield pa.record_batch({"place": pa.array([place], pa.int32()), "key": pa.array([g], pa.int32()), "body": pa.array([x.tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = None
        for x in t.sort_by("place").column("body"):
            own = np.frombuffer(x.as_buffer())
            total = own if total is None else combine(total, own)
        return pa.table({"place": t.column("place").slice(0, 1), "key": t.column("key").slice(0, 1), "body": pa.array([total.tobytes()], pa.binary())})

    parts = blocks.mapInArrow(run, schema).groupBy("key", (F.col("place") % FAN).alias("part")).applyInArrow(add, schema)
    return {r["key"]: np.frombuffer(r["body"]) for r in parts.groupBy("key").applyInArrow(add, schema).collect()}


def products(z: np.ndarray, terms: list[tuple[int, ...]]) -> np.ndarray:
    """Rows x terms, from powers of each input."""
    top = max(max(t) for t in terms)
    powers = [[np.ones(len(z))] for _ in range(z.shape[1])]
    for i, p in enumerate(powers):
        for _ in range(top):
            p.append(p[-1] * z[:, i])
    return np.stack([math.prod((powers[i][e] for i, e in enumerate(t) if e), start=powers[0][0]) for t in terms], 1)


@dataclass
class Fits:
    """Polynomials of all replicates: they differ in ``coef`` (terms x replicates) of plain monomials of standardised inputs."""

    inputs: tuple[str, ...]
    degree: int
    center: np.ndarray
    spread: np.ndarray
    terms: list[tuple[int, ...]]
    models: list[polynomial.PolynomialModel]
    coef: np.ndarray

    def predict(self, X: np.ndarray, replicates: slice = slice(None)) -> np.ndarray:
        return products((X - self.center) / self.spread, self.terms) @ self.coef[:, replicates]


def fit_packed(blocks: DataFrame, inputs: Sequence[str], center: np.ndarray, spread: np.ndarray, degree: int, n: int, alpha: float, seed: int) -> Fits:
    d = len(inputs)
    twice, terms = polynomial.exponents(d, 2 * degree), polynomial.exponents(d, degree)
    m = len(twice) + len(terms)

    def sums(group: int, block: int, rows: np.ndarray) -> np.ndarray:
        rows = rows.reshape(-1, d + 1)
        z, y = (rows[:, :d] - center) / spread, rows[:, d]
        w = weights(seed, group, block, len(rows))
        return np.concatenate([products(z, twice).T @ w, products(z, terms).T @ (w * y[:, None])]).ravel()

    step = max(1, SET_BYTES // (8 * m * GROUP))
    groups = -(-n // GROUP)
    found: dict[int, np.ndarray] = {}
    for s in range(0, groups, step):
        found |= summed(blocks, range(s, min(groups, s + step)), sums)
    total = np.concatenate([found[g].reshape(m, GROUP) for g in range(groups)], 1)[:, :n] if found else np.zeros((m, n))
    at = {t: i for i, t in enumerate(twice)}
    models, coef = [], np.zeros((len(terms), n))
    for b in range(n):
        a = dict(zip(twice, total[: len(twice), b]))
        y = dict(zip(terms, total[len(twice) :, b]))
        if not total[at[(0,) * d], b] > 0:  # a replicate of a tiny table without any row
            a, y = {t: float(not any(t)) for t in twice}, dict.fromkeys(terms, 0.0)
        mean, std, own, intercept = polynomial.solve((a, y, 0.0), terms, alpha)
        models.append(polynomial.PolynomialModel(tuple(inputs), degree, center, spread, terms, mean, std, own, float(intercept)))
        c, const = models[-1].flat()
        coef[:, b] = np.where([any(t) for t in terms], c, const)
    return Fits(tuple(inputs), degree, center, spread, terms, models, coef)


def fit(df: DataFrame, inputs: Sequence[str], outcome: str, degree: int, n: int, alpha: float = polynomial.ALPHA, seed: int = 0) -> Fits:
    """Polynomials of n resamples of all rows, in terms of the table's own standardised inputs."""
    _, center, spread = polynomial.standardisation(df, inputs)
    return fit_packed(packed(df, [*inputs, outcome]), inputs, center, spread, degree, n, alpha, seed)


class Nodes:
    """A lattice over a box whose axes have the same number of nodes to a bandwidth, as many as MOST_NODES allows."""

    def __init__(self, low: np.ndarray, high: np.ndarray, h: float):
        self.per = NODES
        while self.per > 1 and math.prod(np.ceil(self.per * (high - low) / h) + 2) > MOST_NODES:
            self.per -= 1
        self.low, self.h, self.shape = low, h, [int(math.ceil(self.per * w / h)) + 2 for w in high - low]

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def corners(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = (v - self.low) * (self.per / self.h)
        base = np.clip(at.astype(np.int64), 0, np.array(self.shape) - 2)
        part = at - base
        out = [(np.zeros(len(v), np.int64), np.ones(len(v)))]
        for k, n in enumerate(self.shape):
            out = [(i * n + base[:, k] + s, w * (part[:, k] if s else 1 - part[:, k])) for i, w in out for s in (0, 1)]
        return out

    def smooth(self, sums: np.ndarray) -> np.ndarray:
        """The kernel's sums at the nodes, of (nodes, ...) sums."""
        t = sums.reshape(*self.shape, -1)
        for k, n in enumerate(self.shape):
            steps = np.arange(n) / self.per
            t = np.moveaxis(np.tensordot(np.exp(-((steps[:, None] - steps[None, :]) ** 2) / 2), t, (1, k)), 0, k)
        return t.reshape(sums.shape)

    def sigma(self, smoothed: np.ndarray, X: np.ndarray) -> np.ndarray:
        """Local deviations at rows, of (nodes, 2, replicates)."""
        w, v = (sum(a[:, None] * smoothed[i, c] for i, a in self.corners(X)) for c in (0, 1))
        return np.sqrt(np.maximum(v, 0) / np.where(w <= 1e-12, 1e-10, w))


def family_parameters(blocks: DataFrame, groups: Sequence[int], z_of, family: str, first: Sequence[float]) -> dict[int, list[tuple[float, ...]]]:
    """The family's weighted maximum-likelihood parameters of each replicate of the groups."""

    def plain(group: int, block: int, rows: np.ndarray) -> np.ndarray:
        z, w = z_of(group, rows)
        w = w(block)
        live = w > 0
        return np.stack([np.where(live, z, math.inf).min(0), -np.where(live, z, -math.inf).max(0)])

    def sums(group: int, block: int, rows: np.ndarray) -> np.ndarray:
        z, w = z_of(group, rows)
        w = w(block)
        return np.stack([w.sum(0), (w * z).sum(0), (w * z * z).sum(0)])

    edges = {g: x.reshape(2, GROUP) for g, x in summed(blocks, groups, lambda g, b, r: plain(g, b, r).ravel(), np.minimum).items()}
    total = {g: x.reshape(3, GROUP) for g, x in summed(blocks, groups, lambda g, b, r: sums(g, b, r).ravel()).items()}
    n, mean = {g: t[0] for g, t in total.items()}, {g: t[1] / np.maximum(t[0], 1) for g, t in total.items()}
    low, high = {g: e[0] for g, e in edges.items()}, {g: -e[1] for g, e in edges.items()}
    each = lambda loc, scale: {g: list(zip(loc(g).tolist(), scale(g).tolist())) for g in groups}
    if family == "norm":
        return each(lambda g: mean[g], lambda g: np.sqrt(np.maximum(total[g][2] / np.maximum(n[g], 1) - mean[g] ** 2, 0)))
    if family == "expon":
        return each(lambda g: low[g], lambda g: mean[g] - low[g])
    if family == "uniform":
        return each(lambda g: low[g], lambda g: high[g] - low[g])
    if family == "laplace":
        lo, hi = {g: low[g].copy() for g in groups}, {g: high[g].copy() for g in groups}
        for _ in range(4):  # each look is 255 times finer

            def below(group: int, block: int, rows: np.ndarray) -> np.ndarray:
                z, w = z_of(group, rows)
                w = w(block)
                cell = np.ceil((z - lo[group]) / np.maximum(hi[group] - lo[group], 1e-300) * 255).clip(0, 256).astype(np.int64)  # noqa: B023
                return np.stack([np.bincount(cell[:, b], w[:, b], 257) for b in range(GROUP)], 1).ravel()

            for g, x in summed(blocks, groups, below).items():
                k = (np.cumsum(x.reshape(257, GROUP), 0) < n[g] / 2).sum(0).clip(0, 255)
                width = (hi[g] - lo[g]) / 255
                lo[g], hi[g] = lo[g] + np.maximum(k - 1, 0) * width, lo[g] + k * width

        def apart(group: int, block: int, rows: np.ndarray) -> np.ndarray:
            z, w = z_of(group, rows)
            return (w(block) * np.abs(z - hi[group])).sum(0)

        away = summed(blocks, groups, apart)
        return each(lambda g: hi[g], lambda g: away[g] / np.maximum(n[g], 1))
    fits: dict[tuple[int, int], likelihood.Fit | None] = {}
    for g in groups:
        for b in range(GROUP):
            *shape, loc, scale = first
            own = likelihood.started(family, first, n[g][b], low[g][b], high[g][b])
            if own is None:  # the whole table's support does not hold this replicate: begin wider
                width = high[g][b] - low[g][b]
                loc = high[g][b] + 0.05 * width if family == "weibull_max" else low[g][b] - 0.05 * width
                own = likelihood.started(family, (*shape, loc, max(scale, 1.2 * width) if family == "beta" else scale), n[g][b], low[g][b], high[g][b])
            fits[g, b] = own
    key_of = {id(f): k for k, f in fits.items() if f}
    size = 6 + 3 * likelihood.SHAPES[likelihood.KERNELS[family][0]] + (3 if family == "beta" else likelihood.SHAPES[likelihood.KERNELS[family][0]])

    def evaluate(live: list[likelihood.Fit]) -> list[np.ndarray]:
        at = {key_of[id(f)]: likelihood.natural(f.trial) for f in live}

        def own(group: int, block: int, rows: np.ndarray) -> np.ndarray:
            z, w = z_of(group, rows)
            w, out = w(block), np.zeros((GROUP, size))
            for b in range(GROUP):
                if (group, b) in at:
                    some = w[:, b] > 0
                    out[b] = likelihood.sums(z[some, b], family, at[group, b], w[some, b])
            return out.ravel()

        found = summed(blocks, sorted({g for g, _ in at}), own)
        return [found[g].reshape(GROUP, size)[b] for g, b in (key_of[id(f)] for f in live)]

    likelihood.ascend([f for f in fits.values() if f], evaluate, STEPS)
    return {g: [fits[g, b].params if fits[g, b] and math.isfinite(fits[g, b].value) else tuple(first) for b in range(GROUP)] for g in groups}


def quietly(progress: Callable[[int, int], None] | None, n: int) -> Callable[[float], None]:
    """Tells a share of n; what progress raises is ignored."""

    def tell(share: float) -> None:
        try:
            if progress:
                progress(int(n * share), n)
        except Exception:  # noqa: BLE001 - a callback may not stop the run
            pass

    return tell


def bootstrap(df: DataFrame, inputs: Sequence[str], outcome: str, points: np.ndarray, grid_ids: Sequence[int], degree: int, bandwidth: float, family: str, first: Sequence[float], exceed, n: int, seed: int = 0, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """(replicate, grid_id, pod) of n resamples of all rows.

    ``progress(done, n)`` is called as stages of a set of replicates end: models and noise, family, curves.

    ``points`` are the places at which a curve is evaluated, as many in turn for each of ``grid_ids``;
    ``exceed(mean, sigma, params)`` gives the chance of a signal at them.  Noise is smoothed on a lattice
    of up to NODES nodes to a bandwidth, whose relative errors are of the order of 1 / nodes**2; ``first``
    are the parameters from which the family's fits begin.
    """
    d = len(inputs)
    low, high, count = (df.agg(*[f(F.col(f"`{c}`").cast("double")) for c in inputs]).first() for f in (F.min, F.max, F.count))
    _, center, spread = polynomial.standardisation(df, inputs)
    blocks = packed(df, [*inputs, outcome])
    fits = fit_packed(blocks, inputs, center, spread, degree, n, polynomial.ALPHA, seed)
    nodes = Nodes(np.minimum(np.array(low, float), points.min(0)), np.maximum(np.array(high, float), points.max(0)), bandwidth)
    coef = np.pad(fits.coef, ((0, 0), (0, -n % GROUP)), mode="edge")
    terms, groups = fits.terms, -(-n // GROUP)
    spark, step = df.sparkSession, max(1, SET_BYTES // (16 * nodes.size * GROUP))
    out, tell = None, quietly(progress, n)
    for s in range(0, groups, step):
        own = range(s, min(groups, s + step))

        def residuals(group: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = rows.reshape(-1, d + 1)
            mean = products((rows[:, :d] - center) / spread, terms) @ coef[:, group * GROUP : (group + 1) * GROUP]
            return rows[:, :d], rows[:, d, None] - mean

        def noise(group: int, block: int, rows: np.ndarray) -> np.ndarray:
            X, r = residuals(group, rows)
            w = weights(seed, group, block, len(X))
            total = np.zeros((nodes.size, 2, GROUP))
            both = np.stack([w, w * r * r], 1)
            for i, a in nodes.corners(X):
                order = np.argsort(i, kind="stable")
                first = np.flatnonzero(np.diff(i[order], prepend=-1))
                total[i[order][first]] += np.add.reduceat((a[:, None, None] * both)[order], first)
            return total.ravel()

        smoothed = {g: nodes.smooth(x.reshape(nodes.size, 2, GROUP)) for g, x in summed(blocks, own, noise).items()}
        shared = spark.sparkContext.broadcast(smoothed)
        tell((s + 0.3 * len(own)) / groups)

        def z_of(group: int, rows: np.ndarray, shared=shared):
            X, r = residuals(group, rows)
            return r / np.maximum(nodes.sigma(shared.value[group], X), 1e-300), lambda block: weights(seed, group, block, len(X))

        params = family_parameters(blocks, own, z_of, family, first)
        tell((s + 0.8 * len(own)) / groups)

        def curves(batches: Iterable[pa.RecordBatch], shared=shared, params=params) -> Iterable[pa.RecordBatch]:
            basis = products((points - center) / spread, terms)
            for b in batches:
                for k in b.column("id").to_pylist():
                    g, at = divmod(k, GROUP)
                    sigma = nodes.sigma(shared.value[g][:, :, at : at + 1], points)[:, 0]
                    pod = exceed(basis @ coef[:, k], sigma, params[g][at]).reshape(len(grid_ids), -1).mean(1)
                    yield pa.record_batch({"replicate": pa.array(np.full(len(grid_ids), k)), "grid_id": pa.array(list(grid_ids), pa.int64()), "pod": pa.array(pod)})

        first_id, last_id = s * GROUP, min(n, own[-1] * GROUP + GROUP)
        parts = max(1, min(last_id - first_id, 4 * spark.sparkContext.defaultParallelism))
        made = checkpoint.cut(spark.range(first_id, last_id, numPartitions=parts).mapInArrow(curves, "replicate long, grid_id long, pod double"))
        out = made if out is None else out.unionByName(made)
        tell(min(1.0, (s + len(own)) / groups))
        shared.unpersist()
    return out
