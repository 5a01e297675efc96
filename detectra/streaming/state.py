"""Polynomial fits of a stream whose runs are not read again.

Each micro-batch leaves the sums of monomials of its runs, by fold, in a folder of its own, named by
the query and the batch's number: a batch that is replayed writes its folder anew and so adds nothing
twice.  Fits come from the sums of all batches.  Sums are of inputs shifted and scaled by fixed numbers
and are turned into those of inputs standardised over all runs, so fits are those of the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import polynomial, validate

SCHEMA = "fold int, term array<int>, m double, b double, yy double"


def moved(sums: dict[tuple[int, ...], float], axis: int, scale: float, shift: float) -> dict[tuple[int, ...], float]:
    """Sums of monomials after one input z has become scale * z + shift."""
    out = {}
    for t in sums:
        e = t[axis]
        lower = lambda j: sums[(*t[:axis], j, *t[axis + 1 :])]  # noqa: E731, B023
        out[t] = math.fsum(math.comb(e, j) * scale**j * shift ** (e - j) * lower(j) for j in range(e + 1))
    return out


class RunningFits:
    """Fits up to ``degree`` of a growing table, kept under ``path``.

    ``about`` gives for each input a (center, spread) that need only be of the right size.  Folds are
    functions of the row, or of ``row_id``.
    """

    def __init__(self, spark: SparkSession, path: str, inputs: Sequence[str], outcome: str, about: Mapping[str, tuple[float, float]], degree: int = 3, folds: int = polynomial.FOLDS, row_id: str | None = None):
        self.spark, self.path, self.inputs, self.outcome = spark, path, list(inputs), outcome
        self.center, self.spread = (np.array([about[c][i] for c in inputs], float) for i in (0, 1))
        self.degree, self.folds, self.row_id = degree, folds, row_id

    def add(self, batch: DataFrame, query: str, number: int) -> None:
        """The sums of a batch's clean runs, once for each (query, number)."""
        clean = validate.split(batch, self.inputs, self.outcome)[0]
        fold = polynomial.hash_fold(polynomial.row_key(clean, self.inputs, self.outcome, self.row_id), self.folds)
        sums = polynomial.moments(clean, self.inputs, self.outcome, self.degree, fold, self.center, self.spread)
        rows = [(f, list(t), float(v), float(b.get(t, 0.0)), float(yy) if not any(t) else 0.0) for f, (m, b, yy) in sums.folds.items() for t, v in m.items()]
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={query}/batch={number}")

    def sums(self) -> polynomial.Moments:
        """Of all batches, by fold."""
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/query=*/batch=*").groupBy("fold", "term").agg(F.sum("m"), F.sum("b"), F.sum("yy")).collect()
        folds: dict[int, tuple[dict, dict, float]] = {}
        for f, term, m, b, yy in rows:
            own_m, own_b, own_yy = folds.get(f, ({}, {}, 0.0))
            t = tuple(term)
            own_m[t] = m
            if sum(t) <= self.degree:
                own_b[t] = b
            folds[f] = own_m, own_b, own_yy + yy
        return polynomial.Moments(len(self.inputs), self.degree, folds)

    def fits(self, degrees: Iterable[int] | None = None, alpha: float = polynomial.ALPHA) -> polynomial.PolynomialFits:
        """The fits of all runs so far, as ``polynomial.fit_polynomials`` has them for a table."""
        d, own = len(self.inputs), self.sums()
        whole = own.total()[0]
        n = whole[(0,) * d]
        unit = lambda i, e: tuple(e * (j == i) for j in range(d))
        mean = np.array([whole[unit(i, 1)] / n for i in range(d)])
        std = np.sqrt(np.maximum(np.array([whole[unit(i, 2)] / n for i in range(d)]) - mean**2, 0))
        std = np.where(std > 0, std, 1.0)
        folds = {}
        for f, (m, b, yy) in own.folds.items():
            for i in range(d):
                m, b = (moved(x, i, 1 / std[i], -mean[i] / std[i]) for x in (m, b))
            folds[f] = m, b, yy
        center, spread = self.center + mean * self.spread, std * self.spread
        return polynomial.fits_from(polynomial.Moments(d, self.degree, folds), self.inputs, list(degrees or range(1, self.degree + 1)), center, spread, alpha)


def feed_fits(stream: DataFrame, state: RunningFits, query: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch of a stream to the state."""

    def add(batch: DataFrame, number: int) -> None:
        state.add(batch, query, number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
