"""Embedding whitening by matrix-free block Lanczos with full reorthogonalisation.

The covariance V of the distinct vectors is never formed.  Each step is one pass in which tasks
centre their rows X and send X'(XQ) for a block Q of directions; the driver holds the basis, which is
of feature size.  A block that breaks down is filled up with new random directions (a restart), and
the steps end when the residuals of the wanted components are small, or the basis is complete.  V's
trace is the sum of the rows' squared deviations, so a component's share needs no other eigenvalue.

Entries become whole numbers, so that sums, means and deviations are exact.  Rows whose vector is
null or has an entry that is null, not finite or too large for a long are left out.  The dimension
is the most frequent length (of equally frequent ones the larger); rows of another length are left
out too.  Directions without variance are no components: there are as many as the rank at most, and
no rows if all vectors are equal.  Repeated vectors count once in the fit; each row has its results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors, wire

SCALE, SHIFT = 64, 1_000_000
#: Residuals, as a share of the largest eigenvalue, at which components count as found; eigenvalues below RANK of the largest as none.
TOLERANCE, RANK = 1e-14, 1e-12
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Components are columns in falling order of their eigenvalues; ``total`` has the sums S over the n distinct vectors."""

    n: int
    total: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int


class Centred:
    """Rows of whole numbers minus their mean total / n: exact times n, and rounded once."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total

    def times_n(self, x: np.ndarray) -> np.ndarray:
        top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * top + max(map(abs, self.total)) < 2**62:
            return x * self.n - np.array(self.total, np.int64)
        return x.astype(object) * self.n - np.array(self.total, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        y = self.times_n(x)
        return (y / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> pa.Array:
        y = self.times_n(x)
        top = max(int(y.max(initial=0)), -int(y.min(initial=0)))
        if y.shape[1] * top * top < 2**62:
            own = y.astype(np.int64)
            return pa.array((own * own).sum(1)).cast(pa.decimal128(38, 0))
        from decimal import Decimal

        y = y.astype(object)
        return pa.array([Decimal(int(v)) for v in (y * y).sum(1)], pa.decimal128(38, 0))


def part_of(rows: DataFrame, f: Callable[[np.ndarray], np.ndarray], kind: type, size: int) -> np.ndarray:
    """The sum over all rows of f of the matrix of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total, some = np.zeros(size, kind), False
        for b in batches:
            if b.num_rows:
                total, some = total + f(vectors.matrix(b.column("x"))), True
        if some:
            yield vectors.sent(0, total)

    return vectors.summed(rows.mapInArrow(run, vectors.SUMS), kind).get(0, np.zeros(size, kind))


def fill(found: np.ndarray, basis: np.ndarray, width: int, random: np.random.Generator) -> np.ndarray:
    """``width`` orthonormal columns orthogonal to the basis: those found, and random ones where they broke down."""
    out = found
    while out.shape[1] < width:
        more = random.standard_normal((len(basis), width - out.shape[1]))
        for _ in range(3):
            more -= basis @ (basis.T @ more)
            more -= out @ (out.T @ more)
        q, r = np.linalg.qr(more)
        out = np.concatenate([out, q[:, np.abs(np.diag(r)) > 1e-8]], 1)
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenpairs of a symmetric map of d dimensions, and how often it was applied.

    The projection is made of the images of all basis vectors, so restarts need no special case.  A block
    has k columns at least, as fewer could miss copies of an eigenvalue.
    """
    block = max(block, k)
    random = np.random.default_rng(seed)
    basis, images, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    q = fill(np.zeros((d, 0)), basis, min(block, d), random)
    while True:
        w, passes = apply(q), passes + 1
        basis, images = np.concatenate([basis, q], 1), np.concatenate([images, w], 1)
        t = basis.T @ images
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1][:k], s[:, ::-1][:, :k]
        ritz = basis @ s
        residual = np.linalg.norm(images @ s - ritz * values, axis=0)
        if basis.shape[1] == d or basis.shape[1] >= k and residual.max() <= TOLERANCE * max(values[0], 0):
            q, r = np.linalg.qr(ritz)
            return values, q * np.sign(np.diag(r)), passes
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        u, size, _ = np.linalg.svd(w, full_matrices=False)
        u = u[:, size > TOLERANCE * max(values[0], 0)]
        for _ in range(2):
            u = np.linalg.qr(u - basis @ (basis.T @ u))[0]
        q = fill(u, basis, min(block, d - basis.shape[1]), random)[:, : d - basis.shape[1]]


def usable_rows(table: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that count, and their dimension."""
    good = table.filter(vectors.usable(F.col("embedding"), SCALE)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    most = good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return good.filter(F.size("embedding") == d).select("vec_id", vectors.integers(F.col("embedding"), SCALE, SHIFT).alias("x")), d


def fit(rows: DataFrame, d: int, k: int = 16, block: int = 16, seed: int = 11) -> Whitening:
    """The whitening of the distinct vectors x of the rows."""
    none = Whitening(0, [], np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    if not d:
        return none
    distinct = wire.cut(rows.select("x").distinct())

    def sums(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(0), [0], (x & vectors.LOW).sum(0)])

    raw = part_of(distinct, sums, np.int64, 2 * d + 2)
    n, total = int(raw[0]), [(int(h) << 32) + int(x) for h, x in zip(raw[1 : d + 1], raw[d + 2 :])]
    if not n:
        return none
    centred = Centred(n, total)
    trace = float(part_of(distinct, lambda x: np.array([(centred.rows(x) ** 2).sum()]), np.float64, 1)[0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centred.rows(x)
            return (c.T @ (c @ q)).ravel()

        return part_of(distinct, product, np.float64, q.size).reshape(q.shape) / n

    values, components, passes = lanczos(apply, d, min(k, d), block, seed) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), 0)
    live = values > RANK * max(values.max(initial=0.0), 0.0)
    values, components = values[live], components[:, live]
    if not len(values):
        return Whitening(n, total, components, values, trace, 0.0, passes)
    signs = np.sign(components[np.abs(components).argmax(0), np.arange(len(values))])
    components = components * signs
    scaled, m = components / np.sqrt(values), len(values)

    def second(x: np.ndarray) -> np.ndarray:
        w = centred.rows(x) @ scaled
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    moments = part_of(distinct, second, np.float64, m + m * m) / n
    covariance = moments[m:].reshape(m, m) - np.outer(moments[:m], moments[:m])
    return Whitening(n, total, components, values, trace, float(np.abs(covariance - np.eye(m)).max()), passes)


def transform(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """For each row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    deviation is the sum over dimensions of (n * x - S)**2, exactly.
    """
    m = len(fitted.eigenvalues)
    centred, scaled, shares = Centred(fitted.n, fitted.total), fitted.components / np.sqrt(fitted.eigenvalues), fitted.eigenvalues / (fitted.trace or 1.0)
    n, error = fitted.n, fitted.identity_error

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches if m else ():
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = vectors.matrix(part.column("x"))
                rows = pa.array(np.repeat(np.arange(len(x)), m))
                yield pa.record_batch(
                    {
                        "vec_id": part.column("vec_id").take(rows),
                        "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(len(x) * m, n, np.int64)),
                        "deviation": centred.deviation(x).take(rows),
                        "whitened": pa.array((centred.rows(x) @ scaled).ravel()),
                        "explained": pa.array(np.tile(shares, len(x))),
                        "identity_error": pa.array(np.full(len(x) * m, error)),
                    }
                )

    return rows.mapInArrow(run, SCHEMA)


def whiten(table: DataFrame, k: int = 16, block: int = 16, seed: int = 11) -> DataFrame:
    """fit() and transform() of a table's ``vec_id`` and ``embedding`` columns."""
    rows, d = usable_rows(table)
    return transform(rows, fit(rows, d, k, block, seed))
