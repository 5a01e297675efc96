"""Kernel sums of all rows at all rows by a fast Gauss transform.

The inputs' box is cut into cells of at most one bandwidth a side.  One aggregation gives each cell's
monomial moments of the rows and of the rows times a value; they do not depend on the bandwidth, and
those of coarser cells follow from them.  A Gaussian is a product over inputs, so moments become local
expansions axis after axis: along an axis a cell meets the cells within ``REACH`` bandwidths, and the
series of Hermite functions is cut where a bound says so.  A row then reads its sums from its cell's
expansion.  Work is linear in the rows; moments and expansions are of the lattice's size, which is
bounded by ``MOST_CELLS`` numbers and does not grow with the rows.

Error bound: |He_n(t)| exp(-t^2 / 2) <= 1.09 sqrt(n!) exp(-t^2 / 4), and with all offsets within a
fraction rho of a bandwidth from the centres the terms beyond order p of an axis add up to less than
2.2 (sqrt(2) rho)^p / sqrt(p!) * sum_m (sqrt(2) rho)^m / sqrt(m!), times exp(-t^2 / 4), for a row at a
distance of t bandwidths.  Orders are the least with which this is below ``TOLERANCE``.  A row's own
term is taken out as the series gives it, so only rounding is left of it, of about 1e-15.  Rows whose
others together weigh less than ``THIN``, which rounding would touch, are far from each other, so
there are no more of them than the box has room for, whatever the rows: they meet all rows directly.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bandwidths beyond which a weight, under 2e-16, counts as none; the bound on an axis's error; numbers of a lattice's moments.
REACH, TOLERANCE, MOST_CELLS = 8.5, 1e-12, 4_000_000
THIN = 1e-6
#: Bytes of expansions that one job may broadcast, and rows that are expanded at a time.
BROADCAST_BYTES, PASS = 64 << 20, 4096


def order_for(rho: float) -> int:
    """The terms of an axis whose offsets are at most rho bandwidths."""
    x = math.sqrt(2) * max(rho, 1e-12)
    rest = sum(x**m / math.sqrt(math.factorial(m)) for m in range(40))
    p = 1
    while 2.2 * x**p / math.sqrt(math.factorial(p)) * rest > TOLERANCE:
        p += 1
    return p


@dataclass
class Lattice:
    """Cells of ``side`` from ``low``, ``n`` of them along each axis, with moments up to ``order``.

    ``moments`` has the shape (2, n_1, p_1, n_2, p_2, ...): of the rows, and of the rows times the value.
    """

    low: np.ndarray
    side: np.ndarray
    n: list[int]
    order: list[int]
    moments: np.ndarray | None = None

    @classmethod
    def over(cls, low: np.ndarray, high: np.ndarray, bandwidth: float) -> Lattice:
        """For the given bandwidth and wider ones."""
        side, n, order = [], [], []
        for w in np.maximum(high - low, 1e-300):
            k = max(1, math.ceil(w / bandwidth * (1 - 1e-9)))
            side.append(w / k * (1 + 1e-9)), n.append(k), order.append(order_for(min(0.5, w / k / 2 / bandwidth * 1.01)))
        return cls(np.asarray(low, float), np.array(side), n, order)

    @property
    def numbers(self) -> float:
        return math.prod(float(a) * b for a, b in zip(self.n, self.order))

    def place(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, offset from its centre in sides) of rows, by axis; rows outside belong to the nearest cell."""
        at = (X - self.low) / self.side
        cell = np.clip(np.floor(at).astype(np.int64), 0, np.array(self.n) - 1)
        return cell, at - cell - 0.5

    def basis(self, offset: np.ndarray) -> np.ndarray:
        """Products of powers of the offsets, of all axes: rows x terms."""
        out = np.ones((len(offset), 1))
        for k, p in enumerate(self.order):
            powers = offset[:, k, None] ** np.arange(p)
            out = (out[:, :, None] * powers[:, None, :]).reshape(len(out), -1)
        return out

    def coarser(self) -> Lattice:
        """Cells of twice the side along the axes that have more than one."""
        m, side, n = self.moments, self.side.copy(), list(self.n)
        for k, p in enumerate(self.order):
            if n[k] == 1:
                continue
            i = np.arange(p)
            choose = np.array([[math.comb(a, b) for b in i] for a in i], float)
            near = [np.where(i[:, None] >= i, choose * s ** np.maximum(i[:, None] - i, 0) / 2.0 ** i[:, None], 0.0) for s in (-0.5, 0.5)]
            m = np.moveaxis(m, (1 + 2 * k, 2 + 2 * k), (0, 1))
            m = np.concatenate([m, np.zeros_like(m[:1])]) if n[k] % 2 else m
            m = np.tensordot(m[0::2], near[0], (1, 1)) + np.tensordot(m[1::2], near[1], (1, 1))
            m = np.moveaxis(m, (0, -1), (1 + 2 * k, 2 + 2 * k))
            n[k] = -(-n[k] // 2)
            side[k] *= 2
        return Lattice(self.low, side, n, self.order, m)

    def steps(self, k: int, h: float) -> dict[int, np.ndarray]:
        """For each step between cells of an axis, what a source's moments give to a target's expansion."""
        p, s = self.order[k], self.side[k] / h
        a = np.arange(p)
        scale = np.array([s**j / math.factorial(j) for j in a])
        out = {}
        for step in range(-self.n[k] + 1, self.n[k]):
            t = step * s
            if abs(t) > REACH + s:
                continue
            he = [math.exp(-t * t / 2), t * math.exp(-t * t / 2)]
            for j in range(2, 2 * p):
                he.append(t * he[-1] - (j - 1) * he[-2])
            out[step] = np.array(he)[a[:, None] + a[None, :]] * (scale * (-1.0) ** a)[:, None] * scale[None, :]
        return out

    def expansions(self, h: float) -> Expansions:
        m, own = self.moments, []
        for k in range(len(self.n)):
            m = np.moveaxis(m, (1 + 2 * k, 2 + 2 * k), (0, 1))
            shape = m.shape
            m = m.reshape(shape[0], shape[1], -1)
            out, steps = np.zeros_like(m), self.steps(k, h)
            own.append(steps[0])
            for step, a in steps.items():
                lo, hi = max(0, step), min(shape[0], shape[0] + step)
                out[lo:hi] += np.matmul(a, m[lo - step : hi - step])
            m = np.moveaxis(out.reshape(shape), (0, 1), (1 + 2 * k, 2 + 2 * k))
        d = len(self.n)
        cells = m.transpose([0, *range(1, 2 * d, 2), *range(2, 2 * d + 1, 2)]).reshape(2, math.prod(self.n), -1)
        return Expansions(Lattice(self.low, self.side, self.n, self.order), h, own, np.ascontiguousarray(cells.transpose(1, 0, 2)))


@dataclass
class Expansions:
    """Of each cell: the expansions of the sum of weights, and of weights times values; of each axis: a cell's step to itself."""

    lattice: Lattice
    h: float
    own: list[np.ndarray]
    cells: np.ndarray

    def sums(self, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of weights, sum of weights times values, own weight) at rows, as the series give them."""
        cell, offset = self.lattice.place(X)
        flat = np.zeros(len(X), np.int64)
        own = np.ones(len(X))
        for k, n in enumerate(self.lattice.n):
            flat = flat * n + cell[:, k]
            powers = offset[:, k, None] ** np.arange(self.lattice.order[k])
            own *= ((powers @ self.own[k]) * powers).sum(1)
        both = np.einsum("it,ict->ic", self.lattice.basis(offset), self.cells[flat])
        return both[:, 0], both[:, 1], own


def arrays(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def with_moments(rows: DataFrame, names: Sequence[str], value: str, lattice: Lattice) -> Lattice:
    """The lattice with the moments of all rows; a task adds up its cells, and cells meet in a tree."""
    terms = math.prod(lattice.order)
    schema = "cell long, body binary"

    def add(held: dict[int, np.ndarray]) -> pa.Table:
        return pa.table({"cell": pa.array(list(held), pa.int64()), "body": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s in range(0, b.num_rows, PASS):
                part = b.slice(s, PASS)
                cell, offset = lattice.place(arrays(part, names))
                flat = np.ravel_multi_index(tuple(cell.T), lattice.n)
                order = np.argsort(flat, kind="stable")
                first = np.flatnonzero(np.diff(flat[order], prepend=-1))
                basis = lattice.basis(offset[order])
                v = part.column(value).to_numpy(zero_copy_only=False).astype(float)[order]
                both = np.stack([np.add.reduceat(basis, first), np.add.reduceat(basis * v[:, None], first)], 1)
                for c, x in zip(flat[order][first].tolist(), both):
                    held[c] = held[c] + x if c in held else x
        yield from add(held).to_batches()

    def meet(t: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        for c, x in zip(t.column("cell").to_pylist(), t.column("body")):
            x = np.frombuffer(x.as_buffer())
            held[c] = held[c] + x if c in held else x
        return add(held)

    met = rows.mapInArrow(partial, schema).groupBy(F.pmod("cell", F.lit(64))).applyInArrow(meet, schema)
    cells = np.zeros((math.prod(lattice.n), 2, terms))
    for r in met.toLocalIterator():
        cells[r["cell"]] = np.frombuffer(r["body"]).reshape(2, terms)
    d = len(lattice.n)
    m = cells.reshape(*lattice.n, 2, *lattice.order).transpose(d, *(x for k in range(d) for x in (k, d + 1 + k)))
    return Lattice(lattice.low, lattice.side, lattice.n, lattice.order, np.ascontiguousarray(m))


class Transform:
    """Kernel sums of rows (x0, x1, ..., value) for any bandwidth from ``least`` on."""

    def __init__(self, rows: DataFrame, names: Sequence[str], value: str, low: np.ndarray, high: np.ndarray, least: float):
        self.rows, self.names, self.value = rows, list(names), value
        self.levels = [with_moments(rows, names, value, Lattice.over(low, high, least))]

    @staticmethod
    def fits(low: np.ndarray, high: np.ndarray, least: float) -> bool:
        return Lattice.over(low, high, least).numbers <= MOST_CELLS

    def expansions(self, h: float) -> Expansions:
        """From the coarsest cells of at most one bandwidth a side."""
        at = 0
        while True:
            wide = [k for k, n in enumerate(self.levels[at].n) if n > 1]
            if not wide or max(2 * self.levels[at].side[k] for k in wide) > h * (1 + 1e-6):
                return self.levels[at].expansions(h)
            at += 1
            if at == len(self.levels):
                self.levels.append(self.levels[-1].coarser())

    def left_out(self, bandwidths: Sequence[float], floor: float, instead: float) -> np.ndarray:
        """For each bandwidth, the sum over rows of the squared error of the value's estimate from all other rows.

        Weights of at most ``floor`` in all count as ``instead``.
        """
        out, hs = np.zeros(len(bandwidths)), [float(h) for h in bandwidths]
        while hs:
            held, size = [], 0
            for h in hs:
                x = self.expansions(h)
                if held and size + x.cells.nbytes > BROADCAST_BYTES:
                    break
                held.append(x)
                size += x.cells.nbytes
            done = len(bandwidths) - len(hs)
            out[done : done + len(held)] = self._errors(held, floor, instead)
            hs = hs[len(held) :]
        return out

    def _errors(self, held: list[Expansions], floor: float, instead: float) -> np.ndarray:
        shared = self.rows.sparkSession.sparkContext.broadcast(held)
        names, value = self.names, self.value

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            sums, thin = np.zeros(len(shared.value)), []
            for b in batches:
                for s in range(0, b.num_rows, PASS):
                    part = b.slice(s, PASS)
                    X, v = arrays(part, names), part.column(value).to_numpy(zero_copy_only=False).astype(float)
                    for k, x in enumerate(shared.value):
                        w, y, own = x.sums(X)
                        w, y = w - own, y - own * v
                        sure = w >= THIN
                        sums[k] += ((v - y / np.where(sure, w, 1.0))[sure] ** 2).sum()
                        thin += [(k, [*X[i].tolist(), float(v[i])]) for i in np.flatnonzero(~sure).tolist()]
            ks = [*range(len(sums)), *(k for k, _ in thin)]
            yield pa.record_batch({"k": pa.array(ks, pa.int64()), "error": pa.array([*sums, *[0.0] * len(thin)]), "row": pa.array([*[None] * len(sums), *(x for _, x in thin)], pa.list_(pa.float64()))})

        found = self.rows.mapInArrow(run, "k long, error double, row array<double>")
        rows = found.groupBy("k").agg(F.sum("error").alias("error"), F.collect_list("row").alias("thin")).orderBy("k").collect()
        shared.unpersist()
        out = np.array([r["error"] for r in rows])
        thin = [(k, x) for k, r in enumerate(rows) for x in r["thin"]]
        if thin:
            k = np.array([k for k, _ in thin])
            X, v = np.array([x[:-1] for _, x in thin]), np.array([x[-1] for _, x in thin])
            w, y = self._direct(X, np.array([x.h for x in held])[k])
            np.add.at(out, k, (v - y / np.where(w <= floor, instead, w)) ** 2)
        return out

    def _direct(self, X: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weights, and of weights times values, of all rows elsewhere, at a few places with a bandwidth each."""
        names, value = self.names, self.value

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            w, y = np.zeros(len(X)), np.zeros(len(X))
            for b in batches:
                for s in range(0, b.num_rows, step := max(1, (1 << 21) // len(X))):
                    part = b.slice(s, step)
                    rows, v = arrays(part, names), part.column(value).to_numpy(zero_copy_only=False).astype(float)
                    d2 = sum((X[:, k, None] - rows[None, :, k]) ** 2 for k in range(len(names)))
                    own = np.where(d2 > 0, np.exp(-d2 / (2 * h * h)[:, None]), 0.0)
                    w, y = w + own.sum(1), y + own @ v
            yield pa.record_batch({"i": pa.array(np.arange(len(X))), "w": pa.array(w), "y": pa.array(y)})

        rows = self.rows.mapInArrow(run, "i long, w double, y double").groupBy("i").agg(F.sum("w"), F.sum("y")).orderBy("i").collect()
        return np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def at(self, targets: DataFrame, key: str, h: float) -> DataFrame:
        """(key, w, v): sums of weights and of weights times values at the targets, which lie in the lattice's box or near it."""
        shared = targets.sparkSession.sparkContext.broadcast(self.expansions(h))
        names = self.names

        def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, PASS):
                    part = b.slice(s, PASS)
                    w, v, _ = shared.value.sums(arrays(part, names))
                    yield pa.record_batch({key: part.column(key), "w": pa.array(w), "v": pa.array(np.maximum(v, 0.0))})

        return targets.select(key, *names).mapInArrow(run, f"`{key}` {dict(targets.dtypes)[key]}, w double, v double")


def beside(transform: Transform, targets: DataFrame, names: Sequence[str], h: float, floor: float, instead: float) -> DataFrame:
    """The targets, whose inputs have the given names, with ``sigma``, the root of the value's local mean; weights of at most ``floor`` count as ``instead``."""
    shared = targets.sparkSession.sparkContext.broadcast(transform.expansions(h))
    columns = targets.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, PASS):
                part = b.slice(s, PASS)
                w, v, _ = shared.value.sums(arrays(part, names))
                sigma = np.sqrt(np.maximum(v, 0.0) / np.where(w <= floor, instead, w))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigma)], names=[*columns, "sigma"])

    return targets.mapInArrow(run, T.StructType([*targets.schema.fields, T.StructField("sigma", T.DoubleType())]))


def least_of(errors_of, ladder: np.ndarray, tolerance: float, nodes: int = 16) -> float:
    """Where a smooth function is least, from batches of values: on the ladder, then on Chebyshev nodes between neighbours.

    Once the nodes' interpolant agrees with one of lower degree its minimum is the answer; a
    function with jumps is narrowed down to the tolerance instead.
    """
    k = int(np.argmin(errors_of(ladder)))
    lo, hi = ladder[max(k - 1, 0)], ladder[min(k + 1, len(ladder) - 1)]
    while hi - lo > tolerance:
        x = (lo + hi) / 2 - (hi - lo) / 2 * np.cos(np.linspace(0, np.pi, nodes))
        y = np.asarray(errors_of(x))
        full, less = (np.polynomial.Chebyshev.fit(x, y, n, domain=(lo, hi)) for n in (nodes - 1, nodes - 5))
        k = int(np.argmin(y))
        if hi - lo < 0.1 * hi and np.abs(less(x) - y).max() <= 1e-7 * (y.max() - y.min()):
            turns = full.deriv().roots()
            turns = turns[np.abs(turns.imag) < 1e-9 * hi].real
            at = np.array([lo, hi, *turns[(turns > lo) & (turns < hi)]])
            return float(at[np.argmin(full(at))])
        lo, hi = x[max(k - 1, 0)], x[min(k + 1, nodes - 1)]
    return float((lo + hi) / 2)
