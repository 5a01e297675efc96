"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source's target is met by whole passes over the
source and, for the rest, a subset of documents: the same share of every length count, rounded down,
and then a bounded-knapsack dynamic programme over the counts that are left, which comes as near to
the remaining budget as the lengths allow.  Within a length, documents are chosen in the order of a
seeded hash.

A null text has size 0; sources are ordered by code point with null last.  A document of size 0
is never repeated or taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wire

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of (source, source_size) rows: by weight, capped at ``most`` times the size, the excess reshared.

    Water filling in closed form: with sources in the order in which they reach their caps, the
    first k are full when the level that the others then share still exceeds their caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up_to = Window.orderBy("reach", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("reach", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("place", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("budget", share * F.sum("source_size").over(Window.partitionBy()))
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))).withColumn("open", F.sum("weight").over(rest))
    rows = rows.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    # The level at the first source that does not reach its cap is the level of all that do not.
    at = F.min(F.when(F.col("level") < F.col("reach"), F.struct("reach", "place", "level"))).over(Window.partitionBy())
    rows = rows.withColumn("final", at["level"])
    return rows.select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum as near to the budget as can be.

    Most of the budget is met by the same share of every count.  What that leaves is below the sum of
    one document of each size; longest first, whole documents reduce it to less than twice the largest
    size, and the dynamic programme, whose table has that many sums, fits the rest.
    """
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = (counts * budget) // total
    left = budget - int((sizes * take).sum())
    order = np.argsort(-sizes, kind="stable")
    top = int(sizes.max())
    for i in order:
        if left < 2 * top:
            break
        n = min(int(counts[i] - take[i]), 1, (left - top) // int(sizes[i]))
        take[i] += n
        left -= n * int(sizes[i])
    for i in order:
        if left < 2 * top:
            break
        n = min(int(counts[i] - take[i]), (left - top) // int(sizes[i]))
        take[i] += n
        left -= n * int(sizes[i])
    return take + knapsack(sizes, counts - take, left)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum: the reachable sum nearest to the budget, with the counts that make it."""
    room = budget + int(sizes.max())
    first = np.full(room + 1, -1, np.int64)  # the item that first reached a sum
    used = np.zeros(room + 1, np.int32)  # and how many of it that takes
    first[0] = len(sizes)
    for i in np.argsort(-sizes, kind="stable"):
        s, c = int(sizes[i]), int(min(counts[i], room // max(1, sizes[i])))
        if s <= 0 or c <= 0:
            continue
        before = first >= 0
        for n in range(1, c + 1):
            to = np.flatnonzero(before[: room + 1 - n * s]) + n * s
            to = to[first[to] < 0]
            if not len(to):
                break
            first[to], used[to] = i, n
        if first[budget] >= 0:
            break
    sums = np.flatnonzero(first >= 0)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    take = np.zeros(len(sizes), np.int64)
    while at:
        i = first[at]
        take[i] += used[at]
        at -= int(used[at] * sizes[i])
    return take


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, times, taken.

    ``times`` is how often the mix has the document, from 0 to ``most``; ``taken`` is times * size.
    """
    slim = wire.cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("salt", F.shiftrightunsigned("order", 58).cast("int"))
    )
    by_size = slim.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    lengths = by_size.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = fit_targets(sources, weights, share, most)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole = int(pdf.source_size.iloc[0])
        passes = min(int(pdf.target.iloc[0] // whole), most) if whole else 0
        rest = int(round(pdf.target.iloc[0])) - passes * whole if passes < most else 0
        live = pdf["size"].to_numpy() > 0
        take = np.zeros(len(pdf), np.int64)
        if live.any():
            take[live] = fit_counts(pdf["size"].to_numpy()[live], pdf["n"].to_numpy()[live], rest)
        return pdf[["source", "size", "source_size", "target"]].assign(passes=passes * live, extra=take)

    targets = targets.withColumnRenamed("source", "t_source")
    joined = lengths.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    plan = joined.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, passes long, extra long")
    # Which salts are taken whole, and how many documents of the next: a length's documents are never ranked in one task.
    before = Window.partitionBy("p_source", "p_size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumnsRenamed({"source": "p_source", "size": "p_size"})
    quota = by_size.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("source", "size")
    quota = quota.withColumn("quota", F.greatest(F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(0))).withColumnRenamed("salt", "p_salt")
    ranked = slim.join(quota, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")) & (F.col("salt") == F.col("p_salt")))
    within = Window.partitionBy("source", "size", "salt").orderBy("order", "doc_id")
    chosen = F.when(F.col("quota") >= F.col("n"), True).when(F.col("quota") <= 0, False)
    open_ = ranked.withColumn("chosen", chosen)
    sure = open_.filter("chosen is not null")
    tied = open_.filter("chosen is null").withColumn("chosen", F.row_number().over(within) <= F.col("quota"))
    times = F.col("passes") + F.col("chosen").cast("long")
    return sure.unionByName(tied).select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))
