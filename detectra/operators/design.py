"""Latin hypercube designs and space-filling order."""

from __future__ import annotations

import numbers
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws

#: Points of a block of the max-min order.
BLOCK = 256
Ranges = Mapping[str, tuple[float, float]]


def check_ranges(ranges) -> dict[str, tuple[float, float]]:
    """Ranges from a mapping, or from a pandas or Spark frame with Name, Min and Max."""
    if isinstance(ranges, DataFrame):
        ranges = ranges.toPandas()
    if isinstance(ranges, pd.DataFrame):
        if ranges.empty:
            return {}
        missing = {"Name", "Min", "Max"} - set(ranges.columns)
        if missing:
            raise ValueError(f"ranges lack the columns {sorted(missing)}")
        rows = list(zip(ranges["Name"], ranges["Min"], ranges["Max"]))
    elif isinstance(ranges, Mapping):
        rows = [(k, *v) for k, v in ranges.items()]
    else:
        raise TypeError("ranges must be a mapping or a frame with Name, Min and Max")
    if not all(isinstance(r[0], str) for r in rows):
        raise ValueError("'Name' must hold only strings")
    out: dict[str, tuple[float, float]] = {}
    for name, lo, hi in rows:
        try:
            if isinstance(lo, bool) or not isinstance(lo, (numbers.Real, str)):
                raise ValueError
            out[name] = (float(lo), float(hi))
        except (TypeError, ValueError):
            raise ValueError(f"bounds of {name!r} must be numeric") from None
    bad = [k for k, (lo, hi) in out.items() if not lo < hi]
    if bad:
        raise ValueError(f"'Min' must be below 'Max' for {bad}")
    return out


def unit_lhs(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """(id, u0, u1, ...): in every dimension each of n strata holds one point.

    A stratum is the rank of a keyed draw, so dimensions are permuted on their own.
    """
    rows = spark.range(0, n).select("id", *[draws.bits(F.lit(seed), F.lit(j), F.col("id")).alias(f"k{j}") for j in range(d)])
    for j in range(d):
        stratum = F.row_number().over(Window.orderBy(f"k{j}", "id")) - 1
        rows = rows.withColumn(f"u{j}", (stratum + draws.uniform(F.lit(seed), F.lit(f"jitter{j}"), F.col("id"))) / F.lit(float(n)))
    return rows.select("id", *[f"u{j}" for j in range(d)])


def scale(u: Column, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + u * F.lit(float(hi - lo))


def blocks_of(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in blocks of neighbours: halves along the widest axis, again and again."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= BLOCK:
            out.append(np.sort(rows))
            continue
        axis = int(np.argmax(x[rows].max(0) - x[rows].min(0)))
        half = len(rows) // 2
        rows = rows[np.argpartition(x[rows, axis], half)]
        open_ += [rows[:half], rows[half:]]
    return out


def reorder_max_min(points: np.ndarray) -> np.ndarray:
    """Row order in which each point is the farthest from those before it; of ties the first.

    Starts at row 0 on axes scaled to [0, 1].  Points are kept in blocks of neighbours that know the
    largest distance of theirs to the chosen set, so a step looks at the blocks' largest and works on
    those blocks only that the new point is near enough to change.
    """
    n = len(points)
    if n <= 2:
        return np.arange(n)
    lo, hi = points.min(0), points.max(0)
    x = (points - lo) / np.where(hi > lo, hi - lo, 1.0)
    blocks = blocks_of(x)
    home = np.empty(n, np.int64)
    for i, rows in enumerate(blocks):
        home[rows] = i
    low, high = (np.stack([f(x[rows], axis=0) for rows in blocks]) for f in (np.min, np.max))
    near = np.full(n, np.inf)
    most, first = np.full(len(blocks), np.inf), np.array([rows[0] for rows in blocks])
    order, k = np.zeros(n, np.int64), 0
    for i in range(n):
        if i:
            top = np.flatnonzero(most == most.max())
            k = int(first[top].min())
        order[i] = k
        gap = np.maximum(np.maximum(low - x[k], x[k] - high), 0.0)
        touched = np.flatnonzero((gap * gap).sum(1) * (1 - 1e-9) <= most)
        near[k] = -1
        for b in {*touched.tolist(), int(home[k])}:
            rows = blocks[b]
            own = near[rows] = np.minimum(near[rows], ((x[rows] - x[k]) ** 2).sum(1))
            at = int(np.argmax(own))
            most[b], first[b] = own[at], rows[at]
    return order


def max_min_order(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, place): rows of a design in max-min order; the first is that of the smallest key.

    Each place depends on all before it, so the order is found on the driver, which holds the
    designs' coordinates.
    """
    pdf = df.select(F.col(key), *[F.col(f"`{c}`").cast("double") for c in columns]).orderBy(key).toPandas()
    order = reorder_max_min(pdf[columns].to_numpy(float))
    return df.sparkSession.createDataFrame(pdf.iloc[order][[key]].assign(place=range(len(pdf))), f"`{key}` {dict(df.dtypes)[key]}, place long")


def generate_lhs(spark: SparkSession, n: int, ranges, seed: int = 0, reorder: bool = True) -> DataFrame:
    """(id, one column for each range); with ``reorder`` ids are in max-min order."""
    spec = check_ranges(ranges)
    if not spec:
        return spark.createDataFrame([], "id long")
    u = unit_lhs(spark, n, len(spec), seed)
    df = u.select("id", *[scale(F.col(f"u{j}"), lo, hi).alias(k) for j, (k, (lo, hi)) in enumerate(spec.items())])
    if not reorder:
        return df
    pdf = df.orderBy("id").toPandas()
    pdf = pdf.iloc[reorder_max_min(pdf[list(spec)].to_numpy())].reset_index(drop=True)
    return spark.createDataFrame(pdf.assign(id=range(len(pdf))))
