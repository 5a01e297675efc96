"""Streams: a replayed batch counts once, and running fits are those of the table."""

import numpy as np
import pandas as pd
import pytest

from detectra.operators import polynomial
from detectra.plans.study import SimulationStudy
from detectra.streaming import ingest, state


def table(n=240, seed=0):
    r = np.random.default_rng(seed)
    x, z = r.uniform(2, 9, n), r.uniform(-1, 1, n)
    return pd.DataFrame({"x": x, "z": z, "y": 1 + x * z - 0.2 * x * x + r.normal(0, 0.3, n)})


def write_parts(spark, pdf, path, parts):
    for i, part in enumerate(np.array_split(pdf, parts)):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)


def test_running_fits_after_a_replay(spark, tmp_path):
    pdf, src = table(), str(tmp_path / "in")
    write_parts(spark, pdf, src, 4)
    own = state.RunningFits(spark, str(tmp_path / "state"), ["x", "z"], "y", {"x": (5.0, 2.0), "z": (0.0, 1.0)})
    stream = spark.readStream.schema("x double, z double, y double").option("maxFilesPerTrigger", 1).parquet(src)
    failed = []

    def sometimes(batch, number):
        own.add(batch, "runs", number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("after the sums were written")

    with pytest.raises(Exception):
        stream.writeStream.foreachBatch(sometimes).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    state.feed_fits(stream, own, "runs", str(tmp_path / "c")).awaitTermination(120)
    assert failed and own.sums().total()[0][(0, 0)] == len(pdf)
    want = polynomial.fit_polynomials(spark.createDataFrame(pdf), ["x", "z"], "y", (1, 2, 3))
    got = own.fits()
    for key, m in want.models.items():
        assert got.models[key].coef == pytest.approx(m.coef, rel=1e-6, abs=1e-8)
        assert got.models[key].predict(pdf[["x", "z"]]) == pytest.approx(m.predict(pdf[["x", "z"]]), rel=1e-8)
        assert got.cv_mse[key] == pytest.approx(want.cv_mse[key], rel=1e-7) and got.cv_r2[key] == pytest.approx(want.cv_r2[key], rel=1e-7)
    assert got.winner == want.winner


def test_a_study_holds_a_replayed_batch_once(spark, tmp_path):
    pdf, src = table(60), str(tmp_path / "in")
    write_parts(spark, pdf, src, 3)
    stream = spark.readStream.schema("x double, z double, y double").option("maxFilesPerTrigger", 1).parquet(src)
    study, failed, seen = SimulationStudy(spark), [], []
    study.add_data(spark.createDataFrame(table(10, 9)), "y", ["x", "z"])

    def after(s, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("in after")
        seen.append((number, s.data.count()))

    with pytest.raises(Exception):
        ingest.feed_study(stream, study, str(tmp_path / "c"), after).awaitTermination(120)
    again = SimulationStudy(spark)
    again.add_data(spark.createDataFrame(table(10, 9)), "y", ["x", "z"])
    ingest.feed_study(stream, again, str(tmp_path / "c"), after).awaitTermination(120)
    assert failed and again.data.count() == 70 and seen[-1] == (2, 70)
