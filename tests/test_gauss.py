"""The fast Gauss transform against direct sums."""

import numpy as np
import pandas as pd
import pytest

from detectra.operators import gauss, variance


def sample(n, d, seed=0):
    r = np.random.default_rng(seed)
    X = np.concatenate([r.normal(0, 1, (n - 5, d)), r.normal(6, 1, (5, d))]) * np.array([1, 0.6, 0.01])[:d]
    return X, r.normal(0, 1, n) * (0.5 + np.abs(X[:, 0]))


def rows_of(spark, X, e):
    return spark.createDataFrame(pd.DataFrame(X, columns=[f"x{i}" for i in range(X.shape[1])]).assign(residual=e)).repartition(3)


@pytest.mark.parametrize(("d", "least"), [(1, 0.01), (2, 0.02), (3, 0.05)])
def test_errors_of_all_bandwidths(spark, d, least):
    X, e = sample(700, d)
    names = [f"x{i}" for i in range(d)]
    own = variance.LeftOut(rows_of(spark, X, e), names, "residual")
    hs = own.width * np.array([least, 0.07, 0.2, 0.5])
    assert own.errors(hs) == pytest.approx([variance.loo_error(X, e**2, h) for h in hs], rel=1e-9)
    assert own.blocks is None
    assert own.errors(hs[:1] * 0.9) == pytest.approx([variance.loo_error(X, e**2, hs[0] * 0.9)], rel=1e-9)


def test_lattices_that_are_too_large_meet_blocks(spark):
    r = np.random.default_rng(1)
    X, e = r.uniform(0, 1, (300, 4)), r.normal(0, 1, 300)
    own = variance.LeftOut(rows_of(spark, X, e), ["x0", "x1", "x2", "x3"], "residual", 100)
    hs = [0.02, 0.5]
    assert own.errors(hs) == pytest.approx([variance.loo_error(X, e**2, h) for h in hs], rel=1e-9) and own.blocks is not None


def test_local_std_of_large_grids(spark, monkeypatch):
    X, e = sample(400, 2)
    G = np.random.default_rng(2).uniform(-6, 12, (300, 2))
    d2 = ((G[:, None] - X[None]) ** 2).sum(2)
    grid = spark.createDataFrame(pd.DataFrame(G, columns=["x0", "x1"]).assign(grid_id=range(300)))
    for h in (0.3, 1.5):
        w = np.exp(-d2 / (2 * h * h))
        total = w.sum(1)
        want = np.sqrt(w @ e**2 / np.where(total <= 1e-12, 1e-10, total))
        clear = (total > 1e-9) | (total < 1e-14)
        monkeypatch.setattr(variance, "GRID_ROWS", 10)
        got = variance.local_std(grid, rows_of(spark, X, e), ["x0", "x1"], h).toPandas().sort_values("grid_id").sigma.to_numpy()
        assert got[clear] == pytest.approx(want[clear], rel=1e-6, abs=1e-4) and clear.sum() > 150


def test_optimum_is_that_of_direct_sums(spark):
    X, e = sample(5000, 1, 3)
    r2 = e**2
    width = float(X.max() - X.min())
    best = variance.optimise_bandwidth(rows_of(spark, X, e), ["x0"])
    fine = best * (1 + np.linspace(-0.02, 0.02, 9))
    values = np.array([variance.loo_error(X, r2, h) for h in fine])
    turn = np.polynomial.Chebyshev.fit(fine, values, 6).deriv().roots()
    turn = turn[(np.abs(turn.imag) < 1e-12) & (turn.real > fine[0]) & (turn.real < fine[-1])].real
    assert abs(best - turn).min() < 1e-6 * width
    ladder = [variance.loo_error(X, r2, h) for h in width * variance.LADDER]
    assert min(ladder) >= values[4] - 1e-12


def test_work_is_linear_in_the_rows(spark, monkeypatch):
    """Four times the rows are placed four times as often, over a lattice of the same size and in as many passes."""
    import time

    spent = []
    for n in (40_000, 160_000):
        X, e = np.random.default_rng(4).uniform(0, 1, (n, 1)), np.random.default_rng(5).normal(0, 1, n)
        rows = rows_of(spark, X, e)
        own = variance.LeftOut(rows, ["x0"], "residual")
        own.errors([0.1])
        began = time.perf_counter()
        own.errors(0.01 * np.geomspace(1, 50, 12))
        spent.append(time.perf_counter() - began)
        assert own.transform.levels[0].numbers == gauss.Lattice.over(np.zeros(1), np.ones(1), 0.01).numbers
    assert spent[1] < 6 * spent[0] + 1


def test_search_finds_smooth_minima_edges_and_jumps():
    ladder = np.geomspace(0.01, 0.5, 12)
    for at in (0.0123, 0.0787, 0.31):
        assert gauss.least_of(lambda h, at=at: (np.log(np.asarray(h) / at)) ** 2 + 1, ladder, 1e-5) == pytest.approx(at, rel=1e-7)
    assert gauss.least_of(lambda h: -np.asarray(h), ladder, 1e-5) == pytest.approx(0.5, abs=1e-5)
    jump = gauss.least_of(lambda h: np.abs(np.asarray(h) - 0.1) + (np.asarray(h) < 0.1), ladder, 1e-5)
    assert jump == pytest.approx(0.1, abs=1e-4)
    assert np.isfinite(gauss.least_of(lambda h: np.zeros(len(h)), ladder, 1e-5))


def test_marginal_curves_are_the_same_by_either_way(spark, monkeypatch):
    from detectra.operators import integrate, polynomial

    X, e = sample(500, 2, 6)
    df = spark.createDataFrame(pd.DataFrame(X, columns=["x0", "x1"]).assign(y=X[:, 0] + e)).repartition(3)
    m = polynomial.fit_polynomials(df, ["x0", "x1"], "y", (1,)).models["Polynomial", 1]
    train = variance.add_residuals(df, m, "y")
    grid = integrate.poi_grid(df, ["x0"])
    run = lambda: integrate.compute_multi_dim_pod(grid, {"x1": (-1.0, 1.0)}, m, train, 0.4, ("norm", (0.0, 1.0)), 1.0, n_mc=20).toPandas().sort_values("grid_id").pod.to_numpy()
    want = run()
    monkeypatch.setattr(integrate, "DIRECT", 10)
    assert run() == pytest.approx(want, abs=1e-6)
