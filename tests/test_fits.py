"""Conjugate gradients, Kriging's gradients, max-min order, the search by cells, and low-discrepancy points."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from detectra.operators import adaptive, design, kriging, polynomial, sobol


def test_conjugate_gradients_are_the_solution(spark, monkeypatch):
    r = np.random.default_rng(0)
    X = r.uniform(-1, 1, (900, 9))
    y = 3 + X[:, 0] * X[:, 1] - X[:, 2] ** 3 + r.normal(0, 0.1, 900)
    names = [f"x{i}" for i in range(9)]
    df = spark.createDataFrame(pd.DataFrame(X, columns=names).assign(y=y, id=range(900))).repartition(3)
    want = polynomial.fit_polynomials(df, names, "y", (1, 3), folds=3, row_id="id")
    monkeypatch.setattr(polynomial, "MOST_TERMS", 200)  # the cubic has 220
    got = polynomial.fit_polynomials(df, names, "y", (1, 3), folds=3, row_id="id")
    key = ("Polynomial", 3)
    assert len(got.models[key].terms) == 220
    assert got.models[key].coef == pytest.approx(want.models[key].coef, abs=1e-7)
    assert got.models[key].predict(X[:9]) == pytest.approx(want.models[key].predict(X[:9]), abs=1e-7)
    assert got.cv_mse[key] == pytest.approx(want.cv_mse[key], rel=1e-6) and got.cv_r2[key] == pytest.approx(want.cv_r2[key], abs=1e-6)
    assert got.cv_mse["Polynomial", 1] == pytest.approx(want.cv_mse["Polynomial", 1], rel=1e-9)


def test_no_degree_is_dropped(spark, monkeypatch):
    r = np.random.default_rng(1)
    X = r.uniform(0, 1, (200, 4))
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(X, columns=names).assign(y=X.sum(1) ** 2)).repartition(2)
    monkeypatch.setattr(polynomial, "MOST_TERMS", 40)
    monkeypatch.setattr(polynomial, "STEPS", 40)
    fits = polynomial.fit_polynomials(df, names, "y", (2, 4), folds=2)
    assert set(fits.models) == {("Polynomial", 2), ("Polynomial", 4)} and fits.cv_r2["Polynomial", 4] > 0.9


@pytest.mark.parametrize("kernel", kriging.KERNELS)
def test_evidence_gradients(kernel):
    r = np.random.default_rng(2)
    X, y = r.uniform(0, 3, (40, 2)), r.normal(0, 1, 40)
    p = np.array([0.3, 0.2, -0.4])
    f = lambda q: kriging.negative_evidence(q, kernel, X, y, 0.05)
    want = [(f(p + d)[0] - f(p - d)[0]) / 2e-6 for d in 1e-6 * np.eye(3)]
    assert f(p)[1] == pytest.approx(want, rel=1e-5, abs=1e-6)


def test_descent_keeps_bounds_and_finds_minima():
    f = lambda x: (float((x[0] - 3) ** 2 + 10 * (x[1] + 1) ** 2 + x[0] * x[1]), np.array([2 * (x[0] - 3) + x[1], 20 * (x[1] + 1) + x[0]]))
    x, v = kriging.descend(f, np.array([0.0, 0.0]), np.array([-9.0, -9.0]), np.array([9.0, 9.0]), 100)
    assert np.abs(f(x)[1]).max() < 1e-4
    x, v = kriging.descend(f, np.array([0.0, 0.0]), np.array([-1.0, -0.5]), np.array([1.0, 9.0]), 100)
    assert x == pytest.approx([1.0, -0.5])


def test_restarts_only_improve_and_recover_a_process():
    r = np.random.default_rng(3)
    X = r.uniform(0, 10, (80, 1))
    K = 4 * kriging.correlation("RBF", X, X, np.array([1.5])) + 1e-6 * np.eye(80)
    y = np.linalg.cholesky(K) @ r.normal(0, 1, 80) + r.normal(0, 0.1, 80)
    values = [kriging.climb(X, y, "RBF", k)[1] for k in range(4)]
    model, p = kriging.fit(X, y, ["x"], "RBF", restarts=3)
    assert kriging.negative_evidence(p, "RBF", X, y, model.noise)[0] == pytest.approx(min(values))
    assert 0.7 < model.scales[0] < 3 and np.abs(kriging.negative_evidence(p, "RBF", X, y, model.noise)[1]).max() < 1e-2


def slow_order(points):
    lo, hi = points.min(0), points.max(0)
    x = (points - lo) / np.where(hi > lo, hi - lo, 1.0)
    near = ((x - x[0]) ** 2).sum(1)
    near[0], order = -1, [0]
    for _ in range(len(x) - 1):
        k = int(np.argmax(near))
        order.append(k)
        near = np.minimum(near, ((x - x[k]) ** 2).sum(1))
        near[k] = -1
    return order


def test_max_min_order_by_blocks():
    r = np.random.default_rng(4)
    for points in (r.uniform(0, 1, (3000, 2)), r.normal(0, 1, (1500, 3)), np.repeat(r.integers(0, 5, (300, 2)), 4, 0).astype(float), np.zeros((700, 2)), r.uniform(0, 1, (2, 1))):
        assert design.reorder_max_min(points).tolist() == slow_order(points)


def test_max_min_order_of_many_points():
    points = np.random.default_rng(5).uniform(0, 1, (60_000, 2))
    order = design.reorder_max_min(points)
    assert sorted(order) == list(range(60_000))


@pytest.mark.parametrize(("d", "threshold"), [(1, 0.02), (2, 0.05), (4, 0.3), (2, 0.0), (2, 1.5)])
def test_graveyard_by_cells(spark, d, threshold):
    r = np.random.default_rng(6)
    names = [f"x{i}" for i in range(d)]
    C, B = r.uniform(0, 10, (400, d)), r.uniform(-2, 7, (60, d))
    B = np.concatenate([B, B[:5], C[:3]])
    c = spark.createDataFrame(pd.DataFrame(C, columns=names).assign(id=range(400)))
    b = spark.createDataFrame(pd.DataFrame(B, columns=names))
    lo, hi = np.minimum(C.min(0), B.min(0)), np.maximum(C.max(0), B.max(0))
    far = np.sqrt((((C[:, None] - B[None]) / (hi - lo)) ** 2).sum(2)).min(1) > threshold
    got = {x["id"] for x in adaptive.graveyard_filter(c, b, names, threshold).collect()}
    assert got == set(np.flatnonzero(far).tolist())


def test_sobol_points_are_the_published_ones(spark):
    from detectra.functions import sequences

    dims = range(sequences.DIMENSIONS)
    rows = spark.range(1024).select("id", *[sequences.sobol(F.col("id"), j, 10).alias(f"u{j}") for j in dims]).orderBy("id").toPandas()
    # The first points of the authors' program in three dimensions.
    published = [(0, 0, 0), (0.5, 0.5, 0.5), (0.75, 0.25, 0.25), (0.25, 0.75, 0.75), (0.375, 0.375, 0.625), (0.875, 0.875, 0.125), (0.625, 0.125, 0.875), (0.125, 0.625, 0.375), (0.1875, 0.3125, 0.9375), (0.6875, 0.8125, 0.4375)]
    assert rows[["u0", "u1", "u2"]].to_numpy()[:10].tolist() == [list(map(float, p)) for p in published]
    for j in dims:  # every coordinate has one point in each of 1024 strata
        assert sorted((rows[f"u{j}"] * 1024).astype(int)) == list(range(1024))
    cells = (rows.u0 * 32).astype(int) * 32 + (rows.u1 * 32).astype(int)
    assert len(set(cells)) == 1024


def test_sobol_indices_of_fewer_points_are_closer(spark):
    from detectra.functions import sequences

    X = np.random.default_rng(7).uniform(0, 1, (300, 3))
    y = X[:, 0] * X[:, 1] + 0.5 * X[:, 2] ** 2
    m = polynomial.fit_arrays(X, y, ["a", "b", "c"], 2, alpha=0.0)
    # Exact: of x y and z^2 / 2 on the unit cube.
    va, vc = 7 / 144, 0.25 * (1 / 5 - 1 / 9)
    part = 1 / 48 + 1 / 144
    want = {"a": part / (va + vc), "b": part / (va + vc), "c": vc / (va + vc)}
    box = {k: (0.0, 1.0) for k in "abc"}
    error = lambda n: max(abs(r["st"] - want[r["variable"]]) for r in sobol.total_order(spark, m, box, n).collect())
    close = error(1024)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sequences, "DIMENSIONS", 0)
        assert close < error(8192) and close < 0.005
