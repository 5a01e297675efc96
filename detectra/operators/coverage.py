"""Gaps in the sorted values of an input.

The values are dealt into equal-width bins; a bin gives its smallest and largest value, and one pass
over the bins finds the largest gap between them.  Only bins that are wider than that gap are sorted,
each in its own task: none where a bin is empty, as with outliers, and else each a small part of
the column unless most values crowd into one bin while no bin is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def gaps(df: DataFrame, names: Sequence[str], bins: int = BINS) -> DataFrame:
    """variable, lo, hi, gap, gap_start, gap_end: each column's largest gap, of ties the first."""
    v = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("double").alias("x")) for c in names])).alias("r")).select("r.*").filter("x is not null")
    bounds = v.groupBy("variable").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    binned = v.join(F.broadcast(bounds), "variable")  # one row for each variable
    width = (F.col("hi") - F.col("lo")) / bins
    binned = binned.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)))
    ends = binned.groupBy("variable", "lo", "hi", "bin").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    across = Window.partitionBy("variable").orderBy("bin")  # at most ``bins`` rows
    ends = ends.withColumn("following", F.lead("first").over(across))
    step = F.struct((F.col("following") - F.col("last")).alias("gap"), (-F.col("last")).alias("at"), F.col("following").alias("end"))
    between = ends.groupBy("variable", "lo", "hi").agg(F.max(F.when(F.col("following").isNotNull(), step)).alias("top"))
    # A bin no wider than a gap between bins cannot hold a larger one, so only the others are sorted.
    best = between.select(F.col("variable").alias("b_variable"), F.coalesce("top.gap", F.lit(0.0)).alias("best"))
    wide = ends.join(F.broadcast(best), F.col("variable") == F.col("b_variable")).filter(F.col("last") - F.col("first") >= F.col("best"))
    wide = wide.filter(F.col("last") > F.col("first")).select("variable", "bin")
    distinct = binned.join(F.broadcast(wide), ["variable", "bin"]).select("variable", "lo", "hi", "bin", "x").distinct()
    inside = Window.partitionBy("variable", "bin").orderBy("x")
    steps = distinct.withColumn("next", F.lead("x").over(inside)).filter("next is not null")
    own = F.struct((F.col("next") - F.col("x")).alias("gap"), (-F.col("x")).alias("at"), F.col("next").alias("end"))
    within = steps.groupBy("variable", "lo", "hi").agg(F.max(own).alias("top"))
    top = between.unionByName(within).groupBy("variable", "lo", "hi").agg(F.max("top").alias("top"))
    return top.select("variable", "lo", "hi", F.coalesce("top.gap", F.lit(0.0)).alias("gap"), (-F.col("top.at")).alias("gap_start"), F.col("top.end").alias("gap_end"))


def coverage(df: DataFrame, names: Sequence[str], max_gap_ratio: float = 0.20) -> DataFrame:
    """variable, lo, hi, max_gap_ratio (4 decimals), sufficient; the unrounded ratio decides."""
    ratio = F.when(F.col("hi") > F.col("lo"), F.col("gap") / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return gaps(df, names).select("variable", "lo", "hi", F.bround(ratio, 4).alias("max_gap_ratio"), (ratio < max_gap_ratio).alias("sufficient"))
