"""Plot data of values that differ in their last bits from one evaluation to the next."""

import time

import pandas as pd

from detectra.operators import exports


def unsteady(spark):
    """400 values; the four least are 0.1 plus a few ulps, fewer in a later evaluation."""
    begin = time.monotonic_ns()

    def values(batches):
        ulps = max(0, 10**11 - (time.monotonic_ns() - begin)) // 10**6
        for b in batches:
            low = 0.1 + 2.0**-56 * ulps
            yield pd.DataFrame({"x": [low if i < 4 else 0.1 + i / 100 for i in b.id], "y": [1.0 * i for i in b.id]})

    return spark.range(400, numPartitions=4).mapInPandas(values, "x double, y double")


def test_histograms_hold_all_values_of_one_evaluation(spark):
    for h in (exports.histogram(unsteady(spark), "x", 20), exports.coverage_panels(unsteady(spark), ["x", "y"]).filter("variable = 'x'")):
        h = h.toPandas().sort_values("bin")
        assert h.bin.tolist() == list(range(20)) and h.n.sum() == 400 and h.lo.nunique() == 20
