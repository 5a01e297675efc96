"""Residuals and input-dependent noise by kernel smoothing."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import checkpoint
from . import gauss

#: Weights below this count as none; the weight then used instead.
WEIGHT_FLOOR, WEIGHT_LEAST = 1e-12, 1e-10
#: Rows of the smaller side of a kernel join that may be broadcast, grid rows from which a fast Gauss
#: transform is used, and rows of a block where its lattice would be too large.
BROADCAST_ROWS = 200_000
GRID_ROWS = 5_000
BANDWIDTH_ROWS = 5_000
#: Bandwidths of the first look at a search, as shares of the widest input's range.
LADDER = np.geomspace(0.01, 0.5, 12)
#: Nodes to a bandwidth of the lattice that replicates smooth on, and nodes an axis at most.
NODES, LATTICE = 32, 4_096


def add_residuals(df: DataFrame, model, outcome: str, name: str = "residual") -> DataFrame:
    """outcome - prediction, times sqrt(gamma) where the model's outlier factor exceeds 1."""
    factor = math.sqrt(model.gamma) if model.gamma > 1 else 1.0
    return predict(df, model, "__mean").withColumn(name, (F.col(f"`{outcome}`") - F.col("__mean")) * factor).drop("__mean")


def predict(df: DataFrame, model, name: str) -> DataFrame:
    """The model's mean as a column: native for polynomials, Arrow for others."""
    if model.kind == "Polynomial" and len(model.terms) <= 200:
        return df.withColumn(name, model.column())

    def arrow(*cols: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.stack([c.to_numpy(float) for c in cols], 1)))

    return df.withColumn(name, F.pandas_udf(arrow, "double")(*[F.col(f"`{c}`") for c in model.inputs]))


def local_std(grid: DataFrame, train: DataFrame, inputs: Sequence[str], bandwidth: float, key: str = "grid_id", residual: str = "residual") -> DataFrame:
    """(key, sigma): Nadaraya-Watson estimate of the residuals' local deviation at each grid row.

    A stated query set against all rows.  Grids of over GRID_ROWS rows are met by a fast Gauss
    transform, linear in both sides, where its lattice is small enough (relative differences of about
    1e-10); else grid rows are broadcast when there are at most BROADCAST_ROWS, or met block by
    block, and weights are summed before the shuffle.  The key must be unique.  A bandwidth that is
    not positive gives NULL.
    """
    if not bandwidth > 0:
        return grid.select(key, F.lit(None).cast("double").alias("sigma"))
    g = grid.select(F.col(key).alias("__key"), *[F.col(f"`{c}`").cast("double").alias(f"__g{i}") for i, c in enumerate(inputs)])
    t = train.select(F.pow(F.col(f"`{residual}`"), 2).alias("__r2"), *[F.col(f"`{c}`").cast("double").alias(f"__t{i}") for i, c in enumerate(inputs)])
    d2 = sum(((F.col(f"__g{i}") - F.col(f"__t{i}")) * (F.col(f"__g{i}") - F.col(f"__t{i}")) for i in range(len(inputs))), F.lit(0.0))
    w = F.exp(-d2 / (2.0 * bandwidth * bandwidth))
    rows = g.limit(BROADCAST_ROWS + 1).count()
    sums = by_transform(g, t, len(inputs), bandwidth) if rows > GRID_ROWS else None
    if sums is not None:
        pass
    elif rows <= BROADCAST_ROWS:
        sums = t.crossJoin(F.broadcast(g)).select("__key", w.alias("__w"), (w * F.col("__r2")).alias("__v")).groupBy("__key").agg(F.sum("__w").alias("w"), F.sum("__v").alias("v"))
    else:
        blocks = -(-g.count() // BROADCAST_ROWS)
        part = g.withColumn("__block", F.pmod(F.xxhash64("__key"), F.lit(blocks)))
        dealt = t.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sums = dealt.join(part, "__block").select("__key", w.alias("__w"), (w * F.col("__r2")).alias("__v")).groupBy("__key").agg(F.sum("__w").alias("w"), F.sum("__v").alias("v"))
    total = F.when(F.col("w") <= WEIGHT_FLOOR, F.lit(WEIGHT_LEAST)).otherwise(F.col("w"))
    return sums.select(F.col("__key").alias(key), F.sqrt(F.col("v") / total).alias("sigma"))


def box(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values; zeros of an empty table."""
    r = df.agg(*[f(c) for f in (F.min, F.max) for c in names]).first()
    v = np.array([0.0 if x is None else x for x in r], float)
    return v[: len(names)], v[len(names) :]


def by_transform(g: DataFrame, t: DataFrame, d: int, bandwidth: float) -> DataFrame | None:
    """(__key, w, v) of local_std by a fast Gauss transform; None where its lattice would be too large."""
    names = [f"x{i}" for i in range(d)]
    rows = t.select(*[F.col(f"__t{i}").alias(c) for i, c in enumerate(names)], "__r2")
    targets = g.select("__key", *[F.col(f"__g{i}").alias(c) for i, c in enumerate(names)])
    (lo, hi), (low, high) = box(rows, names), box(targets, names)
    lo, hi = np.minimum(lo, low), np.maximum(hi, high)
    if not gauss.Transform.fits(lo, hi, bandwidth):
        return None
    return gauss.Transform(rows, names, "__r2", lo, hi, bandwidth).at(targets, "__key", bandwidth)


class LeftOut:
    """Mean squared errors of the smoothed squared residuals of all rows but the row's own, by bandwidth.

    By a fast Gauss transform, linear in the rows, for all bandwidths whose lattice is small enough;
    finer ones, which only occur with three or more inputs of like ranges, meet all pairs of blocks.
    """

    def __init__(self, train: DataFrame, inputs: Sequence[str], residual: str, most: int = BANDWIDTH_ROWS):
        self.names, self.most = [f"x{i}" for i in range(len(inputs))], most
        self.rows = checkpoint.cut(train.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(inputs, self.names)], F.col(f"`{residual}`").cast("double").alias("r")))
        self.n = self.rows.count()
        self.low, self.high = box(self.rows, self.names)
        self.width = max(float((self.high - self.low).max()), 1e-12) if self.n else 1.0
        self.transform, self.blocks = None, None

    def errors(self, bandwidths: Sequence[float]) -> np.ndarray:
        hs = np.array(bandwidths, float)
        fine = np.array([not gauss.Transform.fits(self.low, self.high, h) for h in hs])
        out = np.zeros(len(hs))
        if not fine.all():
            if self.transform is None or hs[~fine].min() < self.least * (1 - 1e-9):
                self.least = hs[~fine].min()
                squares = self.rows.select(*self.names, (F.col("r") * F.col("r")).alias("r2"))
                self.transform = gauss.Transform(squares, self.names, "r2", self.low, self.high, self.least)
            out[~fine] = self.transform.left_out(hs[~fine], WEIGHT_FLOOR, WEIGHT_LEAST)
        if fine.any():
            self.blocks = self.blocks if self.blocks is not None else packed_blocks(self.rows, self.n, self.most)
            out[fine] = blocked_errors(self.blocks, len(self.names) + 1, hs[fine])
        return out / max(self.n, 1)


def bandwidth_errors(train: DataFrame, inputs: Sequence[str], bandwidths: Sequence[float], residual: str = "residual") -> DataFrame:
    """(bandwidth, error): leave-one-out mean squared error of the smoothed squared residuals."""
    errors = LeftOut(train, inputs, residual).errors(bandwidths)
    return train.sparkSession.createDataFrame([(float(h), float(e)) for h, e in zip(bandwidths, errors)], "bandwidth double, error double")


def loo_error(X: np.ndarray, r2: np.ndarray, h: float) -> float:
    out, n = 0.0, len(X)
    for s in range(0, n, 1024):
        d2 = ((X[s : s + 1024, None, :] - X[None, :, :]) ** 2).sum(2)
        w = np.exp(-d2 / (2 * h * h))
        w[np.arange(len(w)), np.arange(s, s + len(w))] = 0
        total = w.sum(1)
        out += float(((r2[s : s + 1024] - w @ r2 / np.where(total <= WEIGHT_FLOOR, WEIGHT_LEAST, total)) ** 2).sum())
    return out / n


def packed_blocks(rows: DataFrame, n: int, most: int) -> DataFrame:
    """(block, body): all rows as arrays, in blocks of about ``most`` rows; cut, so all passes see the same blocks."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1) for b in batches if b.num_rows]
        if held:
            yield pa.record_batch({"block": pa.array([TaskContext.get().partitionId()], pa.int64()), "body": pa.array([np.concatenate(held).tobytes()], pa.binary())})

    return checkpoint.cut(rows.repartition(max(1, -(-n // most))).mapInArrow(pack, "block long, body binary"))


def blocked_errors(blocks: DataFrame, columns: int, bandwidths: Sequence[float]) -> np.ndarray:
    """Sums of squared leave-one-out errors over all rows, one for each bandwidth."""
    hs = [float(h) for h in bandwidths]

    def opened(x: bytes) -> tuple[np.ndarray, np.ndarray]:
        v = np.frombuffer(x).reshape(-1, columns)
        return v[:, :-1], v[:, -1] ** 2

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for a, c, x, y in zip(*(b.column(k).to_pylist() for k in ("block", "other", "body", "met"))):
                (X, _), (Y, r2) = opened(x), opened(y)
                out = np.empty((len(hs), 2, len(X)))
                for s in range(0, len(X), 512):
                    d2 = ((X[s : s + 512, None, :] - Y[None, :, :]) ** 2).sum(2)
                    for k, h in enumerate(hs):
                        w = np.exp(-d2 / (2 * h * h))
                        if a == c:
                            w[np.arange(len(w)), np.arange(s, s + len(w))] = 0
                        out[k, 0, s : s + 512], out[k, 1, s : s + 512] = w.sum(1), w @ r2
                yield pa.record_batch({"block": pa.array([a], pa.int64()), "sums": pa.array([out.tobytes()], pa.binary())})

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        _, r2 = opened(right.column("body")[0].as_py())
        w, v = sum(np.frombuffer(x.as_buffer()) for x in left.column("sums")).reshape(len(hs), 2, -1).transpose(1, 0, 2)
        errors = ((r2 - v / np.where(w <= WEIGHT_FLOOR, WEIGHT_LEAST, w)) ** 2).sum(1)
        return pa.table({"k": pa.array(np.arange(len(hs))), "error": pa.array(errors)})

    pairs = blocks.crossJoin(blocks.select(F.col("block").alias("other"), F.col("body").alias("met"))).mapInArrow(meet, "block long, sums binary")
    sums = pairs.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(add, "k long, error double").groupBy("k").agg(F.sum("error"))
    return np.array([e for _, e in sorted(sums.collect())])


def optimise_bandwidth(train: DataFrame, inputs: Sequence[str], residual: str = "residual", most: int = BANDWIDTH_ROWS) -> float:
    """The leave-one-out bandwidth between 0.01 and 0.5 of the widest input range, over all rows.

    ``most`` is the size of a block where LeftOut needs blocks.
    """
    own = LeftOut(train, inputs, residual, most)
    return gauss.least_of(own.errors, own.width * LADDER, 1e-5 * own.width)


def fixed_bandwidth(df: DataFrame, inputs: Sequence[str], ratio: float = 0.1) -> float:
    v = df.agg(*[(F.max(f"`{c}`") - F.min(f"`{c}`")).cast("double") for c in inputs]).first()
    return ratio * max(v)


def fit_variance_model(df: DataFrame, model, inputs: Sequence[str], outcome: str, auto_bandwidth: bool = True, bandwidth_ratio: float = 0.1) -> tuple[DataFrame, float]:
    """(the table with its residuals, bandwidth)."""
    train = add_residuals(df, model, outcome)
    return train, optimise_bandwidth(train, inputs) if auto_bandwidth else fixed_bandwidth(df, inputs, bandwidth_ratio)


def smooth(train_X: np.ndarray, r2: np.ndarray, X: np.ndarray, h: float, cells: int = 1 << 22) -> np.ndarray:
    """local_std over arrays, in blocks."""
    out = np.empty(len(X))
    step = max(1, cells // max(1, len(train_X)))
    n = (train_X**2).sum(1)
    for s in range(0, len(X), step):
        x = X[s : s + step]
        w = np.exp(-np.maximum((x**2).sum(1)[:, None] + n - 2 * x @ train_X.T, 0) / (2 * h * h))
        total = w.sum(1)
        out[s : s + step] = np.sqrt(w @ r2 / np.where(total <= WEIGHT_FLOOR, WEIGHT_LEAST, total))
    return out


class Lattice:
    """``smooth`` for one or two inputs, from sums over a lattice with ``NODES`` nodes to a bandwidth.

    Each training row is shared among its neighbouring nodes, the kernel acts along one axis after
    the other, and estimates are read between nodes, so the work is linear in the rows, which may be
    added in parts.  Relative errors are of the order of (1 / NODES)^2.  It is too large with more
    inputs, or over ``LATTICE`` nodes an axis.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, h: float):
        self.lo, self.h = lo, h
        self.shape = [int(np.ceil(NODES * w / h)) + 2 for w in hi - lo]
        self.fits = len(self.shape) <= 2 and max(self.shape) <= LATTICE
        self.size = int(np.prod(self.shape)) if self.fits else 0
        self.sums = [np.zeros(self.size), np.zeros(self.size)]

    def corners(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = (v - self.lo) * (NODES / self.h)
        base = np.minimum(at.astype(np.int64), np.array(self.shape) - 2)
        part = at - base
        out = [(np.zeros(len(v), np.int64), np.ones(len(v)))]
        for k, n in enumerate(self.shape):
            out = [(i * n + base[:, k] + s, w * (part[:, k] if s else 1 - part[:, k])) for i, w in out for s in (0, 1)]
        return out

    def add(self, X: np.ndarray, weight: np.ndarray, r2: np.ndarray) -> None:
        for i, w in self.corners(X):
            w = w * weight
            self.sums[0] += np.bincount(i, w, self.size)
            self.sums[1] += np.bincount(i, w * r2, self.size)

    def smooth(self) -> None:
        """Once all rows are added."""
        for j, t in enumerate(self.sums):
            t = t.reshape(self.shape)
            for k, n in enumerate(self.shape):
                steps = np.arange(n) / NODES
                kernel = np.exp(-((steps[:, None] - steps[None, :]) ** 2) / 2)
                t = np.moveaxis(np.tensordot(kernel, t, (1, k)), 0, k)
            self.sums[j] = t.ravel()

    def read(self, X: np.ndarray) -> np.ndarray:
        at = self.corners(X)
        total, v = (sum(w * s[i] for i, w in at) for s in self.sums)
        return np.sqrt(v / np.where(total <= WEIGHT_FLOOR, WEIGHT_LEAST, total))


def smooth_binned(train_X: np.ndarray, r2: np.ndarray, X: np.ndarray, h: float) -> np.ndarray:
    """``smooth`` by a ``Lattice``, directly where that is too large."""
    lattice = Lattice(np.minimum(train_X.min(0), X.min(0)), np.maximum(train_X.max(0), X.max(0)), h)
    if not lattice.fits:
        return smooth(train_X, r2, X, h)
    lattice.add(train_X, np.ones(len(r2)), r2)
    lattice.smooth()
    return lattice.read(X)
