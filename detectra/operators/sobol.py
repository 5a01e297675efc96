"""Total-order sensitivity by Saltelli's design and Jansen's estimator."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, sequences
from . import variance

#: Points of each matrix, a power of two.
SAMPLES = 2048


def total_order(spark: SparkSession, model, bounds: Mapping[str, tuple[float, float]], n: int = SAMPLES, seed: int = 5) -> DataFrame:
    """(variable, st): total-order indices clamped to [0, 1]; 0 for a flat model.

    For each input, A and the same points with that input from B differ in it only.  A and B are the
    halves of a Sobol' sequence; coordinates beyond its dimensions are keyed draws.
    """
    names = list(bounds)
    d = len(names)
    bits = max(1, (n - 1).bit_length())
    point = lambda j: sequences.sobol(F.col("id"), j, bits) if j < sequences.DIMENSIONS else draws.uniform(F.lit(seed), F.lit(j), F.col("id"))
    base = spark.range(0, n).select("id", *[point(j).alias(f"a{j}") for j in range(d)], *[point(d + j).alias(f"b{j}") for j in range(d)])
    which = base.withColumn("v", F.explode(F.array(*[F.lit(k) for k in range(-1, d)])))
    at = {c: F.lit(float(lo)) + F.when(F.col("v") == j, F.col(f"b{j}")).otherwise(F.col(f"a{j}")) * float(hi - lo) for j, (c, (lo, hi)) in enumerate(bounds.items())}
    f = variance.predict(which.select("id", "v", *[x.alias(c) for c, x in at.items()]), model, "f").select("id", "v", "f")
    plain = f.filter("v = -1").select(F.col("id").alias("i"), F.col("f").alias("fa"))
    total = plain.agg(F.var_pop("fa").alias("var"))
    st = f.filter("v >= 0").join(plain, F.col("id") == F.col("i")).groupBy("v").agg((F.avg(F.pow(F.col("fa") - F.col("f"), 2)) / 2).alias("e"))
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("v") + 1)
    value = F.when(F.col("var") > 0, F.least(F.greatest(F.col("e") / F.col("var"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return st.crossJoin(F.broadcast(total)).select(named.alias("variable"), value.alias("st"))  # one row
