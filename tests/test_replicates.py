"""Resamples over all rows, and progress while they are made."""

import time

import numpy as np
import pandas as pd
import pytest

from detectra.operators import adaptive, bootstrap, errors, integrate, polynomial, progress, replicates, sufficiency, variance


def table(spark, n=600, seed=0, noise=None):
    r = np.random.default_rng(seed)
    x, z = r.uniform(0, 10, n), r.uniform(0, 1, n)
    e = (noise or (lambda r, n: r.normal(0, 1, n)))(r, n) * (0.3 + 0.1 * x)
    pdf = pd.DataFrame({"x": x, "z": z, "y": 1 + 2 * x - 0.1 * x * x + z + e})
    return spark.createDataFrame(pdf).repartition(3), pdf


def test_weights_are_poisson():
    w = np.concatenate([replicates.weights(1, g, 5, 8000).ravel() for g in range(2)])
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert (np.bincount(w.astype(int), minlength=4)[:4] / len(w)) == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.003)
    assert (replicates.weights(1, 0, 5, 10) == replicates.weights(1, 0, 5, 10)).all()
    assert (replicates.weights(1, 0, 5, 10) != replicates.weights(1, 0, 6, 10)).any()


def test_fits_are_those_of_weighted_rows(spark):
    df, _ = table(spark, 500)
    n = 70
    blocks = replicates.packed(df, ["x", "z", "y"])
    fits = replicates.fit_packed(blocks, ["x", "z"], np.array([5.0, 0.5]), np.array([3.0, 0.3]), 2, n, 0.0, 9)
    rows = [(r["block"], np.frombuffer(r["body"]).reshape(-1, 3)) for r in blocks.collect()]
    X, y = (np.concatenate([v[:, s] for _, v in rows]) for s in (slice(0, 2), 2))
    features = replicates.products((X - fits.center) / fits.spread, fits.terms)
    for b in (0, 63, 64, 69):
        w = np.concatenate([replicates.weights(9, b // 64, block, len(v))[:, b % 64] for block, v in rows])
        want = np.linalg.lstsq(features * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        assert fits.coef[:, b] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert fits.predict(X[:5], slice(b, b + 1))[:, 0] == pytest.approx(fits.models[b].predict(X[:5]))


def test_spreads_agree_with_row_resampling(spark):
    df, pdf = table(spark, 400)
    got = sufficiency.convergence(df, ["x", "z"], "y", n=300).toPandas().groupby("probe").prediction.std()
    X, y = pdf[["x", "z"]].to_numpy(), pdf.y.to_numpy()
    probes = np.quantile(X, sufficiency.PROBES, axis=0)
    r = np.random.default_rng(1)
    want = np.std([polynomial.fit_arrays(X[i], y[i], ["x", "z"], 2, alpha=0.0).predict(probes) for i in (r.integers(0, 400, 400) for _ in range(300))], axis=0)
    assert got.to_numpy() == pytest.approx(want, rel=0.2)  # either has an error of 4 %
    assert adaptive.sample_uncertainty(df, ["x", "z"], "y", 5).count() == 5


@pytest.mark.parametrize(("family", "noise"), [("norm", None), ("gumbel_r", lambda r, n: r.gumbel(0, 1, n)), ("laplace", lambda r, n: r.laplace(0, 1, n))])
def test_bootstrap_over_all_rows_agrees_with_resampled_rows(spark, monkeypatch, family, noise):
    df, pdf = table(spark, 500, 2, noise)
    grid, calls = integrate.poi_grid(df, ["x"], 12) if "n" in integrate.poi_grid.__code__.co_varnames else integrate.poi_grid(df, ["x"]), []
    args = (df, ["x", "z"], "y", grid, ["x"], {"z": (0.0, 1.0)}, ("Polynomial", 2), 1.0, family, 9.0)
    small = bootstrap.bootstrap_curves(*args, n_boot=120, n_mc=20).toPandas()
    monkeypatch.setattr(bootstrap, "MOST_CELLS", 10)
    monkeypatch.setattr(replicates, "SET_BYTES", 1 << 20)
    whole = bootstrap.bootstrap_curves(*args, n_boot=120, n_mc=20, progress=lambda a, b: calls.append((a, b))).toPandas()
    assert len(whole) == len(small) and set(whole.replicate) == set(range(120))
    a, b = (t.groupby("grid_id").pod.agg(["mean", "std"]) for t in (small, whole))
    clear = a["std"] > 1e-3
    assert clear.sum() >= 3
    assert (b["mean"] - a["mean"]).abs().max() < 5 * (a["std"] / np.sqrt(120)).max() + 2e-3
    assert (b["std"][clear] / a["std"][clear]).between(0.65, 1.5).all()
    assert calls[-1] == (120, 120) and len(calls) >= 3 and calls == sorted(calls)


def test_family_parameters_are_weighted_maxima(spark):
    """Every family, against a fit of the rows repeated by their weights."""
    r = np.random.default_rng(3)
    z = r.gamma(3, 1, 400)
    df = spark.createDataFrame(pd.DataFrame({"z": z})).repartition(2)
    blocks = replicates.packed(df, ["z"])
    rows = [(x["block"], np.frombuffer(x["body"])) for x in blocks.collect()]

    def z_of(group, v):
        return np.repeat(v[:, None], replicates.GROUP, 1), lambda block: replicates.weights(4, group, block, len(v))

    for family in ("norm", "expon", "uniform", "laplace", "gamma", "gumbel_r", "logistic", "t", "weibull_min"):
        first = errors.fit(z, family)
        got = replicates.family_parameters(blocks, [0], z_of, family, first)[0]
        for b in (0, 5):
            w = np.concatenate([replicates.weights(4, 0, block, len(v))[:, b] for block, v in rows]).astype(int)
            own = np.repeat(np.concatenate([v for _, v in rows]), w)
            if family == "laplace":
                assert got[b] == pytest.approx(errors.fit(own, family), abs=0.02)
            else:
                assert errors.aic(own, family, got[b]) <= errors.aic(own, family, errors.fit(own, family)) + 1e-4


def test_nodes_smooth_like_direct_sums():
    r = np.random.default_rng(5)
    for d in (1, 2, 3):
        X, r2, P = r.uniform(0, 4, (300, d)), r.random(300), r.uniform(0, 4, (40, d))
        nodes = replicates.Nodes(np.zeros(d), np.full(d, 4.0), 0.8)
        sums = np.zeros((nodes.size, 2, 1))
        for i, a in nodes.corners(X):
            np.add.at(sums[:, 0, 0], i, a)
            np.add.at(sums[:, 1, 0], i, a * r2)
        got = nodes.sigma(nodes.smooth(sums), P)[:, 0]
        assert got == pytest.approx(variance.smooth(X, r2, P, 0.8), rel=3 / nodes.per**2 + 1e-3)


def test_progress_is_told_while_the_job_runs(spark):
    calls = []

    def slow(batches):
        for b in batches:
            time.sleep(0.5)
            yield b

    began = time.perf_counter()
    df = spark.range(0, 12, numPartitions=12).mapInArrow(slow, "id long")
    out = progress.watched(df, 100, lambda done, total: calls.append((done, total, time.perf_counter() - began)))
    spent = time.perf_counter() - began
    assert out.count() == 12 and calls[-1][:2] == (100, 100)
    assert [c[0] for c in calls] == sorted({c[0] for c in calls}) and any(0 < c[0] < 100 and c[2] < 0.8 * spent for c in calls)

    def fails(done, total):
        raise RuntimeError

    assert progress.watched(spark.range(3), 3, fails).count() == 3
    assert progress.watched(spark.range(3), 3, None).count() == 3
