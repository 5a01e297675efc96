"""Newton fits against direct searches, and over rows against arrays."""

import math

import numpy as np
import pandas as pd
import pytest

from detectra.functions import distributions, special
from detectra.operators import errors, likelihood

PLACES = {"gumbel_r": (0.3, 0.5), "gumbel_l": (-0.3, 0.5), "logistic": (0.2, 0.4), "weibull_min": (1.7, -0.2, 0.8), "weibull_max": (1.7, -1.2, 0.8), "gamma": (2.2, -0.1, 0.3), "t": (5.0, 0.3, 0.2), "beta": (2.0, 3.0, -0.1, 1.3)}
DRAWS = {"gumbel_r": lambda r, n: r.gumbel(0, 1, n), "gumbel_l": lambda r, n: -r.gumbel(1, 2, n), "logistic": lambda r, n: r.logistic(3, 1, n), "weibull_min": lambda r, n: r.weibull(2, n), "weibull_max": lambda r, n: 5 - r.weibull(2, n), "gamma": lambda r, n: r.gamma(3, 1, n) - 3, "t": lambda r, n: r.standard_t(4, n), "beta": lambda r, n: r.beta(2, 3, n)}


def nelder_mead(f, start: np.ndarray, steps: int = 400, spread: float = 0.25, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Downhill simplex; infinite values are allowed."""
    n = len(start)
    points = [np.array(start, float)]
    for i in range(n):
        p = points[0].copy()
        p[i] += spread * (abs(p[i]) if p[i] else 1.0)
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if np.isfinite(values[-1]) and values[-1] - values[0] < tolerance * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        far = middle + (middle - points[-1])
        v = f(far)
        if v < values[0]:
            further = middle + 2 * (middle - points[-1])
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (far, v)
        elif v < values[-2]:
            points[-1], values[-1] = far, v
        else:
            near = middle + 0.5 * ((far if v < values[-1] else points[-1]) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *(points[0] + 0.5 * (p - points[0]) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    k = int(np.argmin(values))
    return points[k], float(values[k])


@pytest.mark.parametrize("family", PLACES)
def test_derivatives(family):
    z, p = np.random.default_rng(0).uniform(0.1, 0.9, 50), PLACES[family]
    place = np.array([*np.log(p[:-2]), p[-2], math.log(p[-1])])
    f = lambda q: likelihood.derivatives(50, family, likelihood.natural(q), likelihood.sums(z, family, likelihood.natural(q)))
    value, grad, hess = f(place)
    steps = 1e-5 * np.eye(len(place))
    assert value == pytest.approx(np.sum(distributions.log_pdf(z, family, (*p[:-2], likelihood.KERNELS[family][1] * p[-2], p[-1]))))
    assert grad == pytest.approx(np.array([(f(place + d)[0] - f(place - d)[0]) / 2e-5 for d in steps]), abs=1e-6)
    assert hess == pytest.approx(np.array([(f(place + d)[1] - f(place - d)[1]) / 2e-5 for d in steps]), abs=1e-5)


def test_digamma_and_trigamma():
    for x in (0.1, 1.0, 3.7, 50.0):
        assert special.digamma(x) == pytest.approx((math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5, rel=1e-6)
        assert special.trigamma(x) == pytest.approx((special.digamma(x + 1e-5) - special.digamma(x - 1e-5)) / 2e-5, rel=1e-6)


@pytest.mark.parametrize("family", DRAWS)
def test_fits_are_as_good_as_a_simplex_search(family):
    z = DRAWS[family](np.random.default_rng(1), 4000)
    k = len(PLACES[family]) - 2

    def loss(p):
        with np.errstate(all="ignore"):
            v = -float(np.sum(distributions.log_pdf(z, family, (*np.exp(p[:k]), p[k], math.exp(min(p[k + 1], 50))))))
        return v if math.isfinite(v) else math.inf

    p = errors.fit(z, family)
    value = np.sum(distributions.log_pdf(z, family, p))
    place, least = nelder_mead(loss, np.array([*np.log(p[:k]), p[k], math.log(p[k + 1])]), steps=2000, tolerance=1e-14)
    assert value >= -least - 1e-6
    assert errors.best_of(z)[0] == family or errors.aic(z, *errors.best_of(z)) <= errors.aic(z, family, p) + 1e-9
    assert np.array(p) == pytest.approx(np.array([*np.exp(place[:k]), place[k], math.exp(place[k + 1])]), rel=0.02, abs=0.02)


def test_passes_over_all_rows_are_the_fit_of_the_array(spark):
    for family in ("gamma", "logistic", "weibull_max"):
        z = DRAWS[family](np.random.default_rng(2), 3000)
        rows = spark.createDataFrame(pd.DataFrame({"z": z})).repartition(3)
        whole, passes = errors.newton_fits(rows, "z"), errors.newton_fits(rows, "z", most=300)
        assert whole[family][0] == pytest.approx(errors.fit(z, family), rel=1e-6)
        assert passes[family][0] == pytest.approx(whole[family][0], rel=1e-5) and passes[family][1] == pytest.approx(whole[family][1], rel=1e-9)
        train = rows.selectExpr("z AS residual", "row_number() OVER (ORDER BY z) AS id")
        name, params = errors.infer_best_distribution(train, train.selectExpr("id", "2.0D AS sigma"), "id")
        best = errors.best_of(z / 2)
        assert name == best[0] and params == pytest.approx(best[1], rel=1e-4)


def test_odd_values(spark):
    train = lambda v: spark.createDataFrame(pd.DataFrame({"residual": v, "id": range(len(v))}), "residual double, id long")
    for v in ([], [1.0, math.nan], [1.0, math.inf], [1.0, None]):
        assert errors.infer_best_distribution(train(v), train(v).selectExpr("id", "1.0D AS sigma"), "id") == errors.DEFAULT
    same = errors.infer_best_distribution(train([2.0] * 5), train([2.0] * 5).selectExpr("id", "1.0D AS sigma"), "id")
    assert same[0] in distributions.FAMILIES
