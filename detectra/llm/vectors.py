"""What the operators on vectors share: clean integer vectors, Arrow lists as matrices, exact sums in a tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 256
SUMS = "place int, key int, body binary"
LOW = (1 << 32) - 1


def usable(vector: Column, scale: float) -> Column:
    """Neither null nor with entries that are null, not finite, or too large for a long when scaled."""
    entries = vector.cast("array<double>")
    return vector.isNotNull() & F.coalesce(F.forall(entries, lambda c: F.coalesce(F.abs(c) < F.lit(2.0**62 / scale), F.lit(False))), F.lit(False))


def integers(vector: Column, scale: float, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of each entry, as longs."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long"))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of longs."""
    flat = np.asarray(lists.flatten())
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def split(totals: list[int]) -> np.ndarray:
    """Whole numbers of any size as two longs each, which add up without overflow."""
    return np.array([x >> 32 for x in totals] + [x & LOW for x in totals], np.int64)


def joined(parts: np.ndarray) -> list[int]:
    """The numbers that split() took apart, also after sums."""
    high, low = parts[: len(parts) // 2].tolist(), parts[len(parts) // 2 :].tolist()
    return [(h << 32) + x for h, x in zip(high, low)]


def sent(key: int, body: np.ndarray) -> pa.RecordBatch:
    """A task's part of a sum."""
    return pa.record_batch({"place": pa.array([TaskContext.get().partitionId()], pa.int32()), "key": pa.array([key], pa.int32()), "body": pa.array([body.tobytes()], pa.binary())})


def summed(rows: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """The sum of the arrays of each key.  Tasks' parts meet in groups of places and then by key, in order of place."""

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        total = sum(np.frombuffer(x.as_buffer(), kind) for x in t.column("body"))
        return pa.table({"place": t.column("place").slice(0, 1), "key": t.column("key").slice(0, 1), "body": pa.array([total.tobytes()], pa.binary())})

    parts = rows.groupBy("key", (F.col("place") % FAN).alias("part")).applyInArrow(add, SUMS)
    return {r["key"]: np.frombuffer(r["body"], kind) for r in parts.groupBy("key").applyInArrow(add, SUMS).collect()}
