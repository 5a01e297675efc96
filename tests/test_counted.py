"""Replicates from counts of drawn rows: the same curves as of the resampled rows, in little memory."""

import tracemalloc

import numpy as np
import pytest

from detectra.functions import distributions
from detectra.operators import bootstrap, errors, polynomial, variance


def data(n, d):
    r = np.random.default_rng(0)
    X = np.floor(r.uniform(0, 40, (n, d)))
    return X, 2 * X[:, 0] + 0.1 * X.sum(1) ** 2 + r.normal(0, 5, n)


@pytest.mark.parametrize(("family", "d", "degree"), [("norm", 1, 1), ("norm", 2, 3), ("gumbel_r", 1, 2), ("laplace", 1, 1)])
def test_counted_replicates_are_the_resampled_ones(monkeypatch, family, d, degree):
    X, y = data(5000, d)
    names, points = ["a", "b"][:d], np.linspace(0, 40, 30)[:, None].repeat(d, 1)
    monkeypatch.setattr(bootstrap, "PART", 700)
    for b in (0, 3):
        got = bootstrap.replicate_pod(b, X, y, points, 30, names, ("Polynomial", degree), 4.0, family, [90.0])[:, 0]
        pick = np.random.default_rng(b).integers(0, len(X), len(X))
        Xb, yb = X[pick], y[pick]
        model = polynomial.fit_arrays(Xb, yb, names, degree)
        r = yb - model.predict(Xb)
        params = errors.fit(r / variance.smooth_binned(Xb, r * r, Xb, 4.0), family)
        want = 1 - distributions.cdf((90.0 - model.predict(points)) / variance.smooth_binned(Xb, r * r, points, 4.0), family, params)
        assert got == pytest.approx(want, abs=1e-8)


def test_a_replicate_holds_little_beside_the_rows():
    X, y = data(400_000, 1)
    points = np.linspace(0, 40, 30)[:, None]
    tracemalloc.start()
    bootstrap.replicate_pod(0, X, y, points, 30, ["a"], ("Polynomial", 1), 4.0, "norm", [90.0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(X)  # the rows themselves are 16 bytes each
