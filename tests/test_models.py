import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from detectra.functions import distributions, grids, special
from detectra.operators import bootstrap, errors, integrate, kriging, linear, polynomial, reliability, sobol, variance
from detectra.plans.study import SimulationStudy, estimate_seconds


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def quadratic(spark, n=60):
    x = np.linspace(0, 5, n)
    return x, 0.5 * x**2 + np.random.default_rng(0).normal(0, 0.2, n)


def test_special_functions():
    assert special.norm_cdf(1.96) == pytest.approx(0.9750021, abs=1e-7)
    assert special.norm_ppf(np.array([0.975, 0.5, 0.001])) == pytest.approx([1.959963985, 0, -3.090232306], abs=1e-8)
    assert special.gammaln(10.0) == pytest.approx(math.lgamma(10))
    assert special.gammainc(2.0, np.array([1.0, 5.0])) == pytest.approx([1 - 2 / math.e, 1 - 6 * math.exp(-5)])
    assert special.betainc(2.0, 3.0, np.array([0.4])) == pytest.approx([0.5248], abs=1e-9)


@pytest.mark.parametrize("family", list(distributions.FAMILIES))
def test_cdf_integrates_pdf_and_ppf_inverts(family):
    params = {0: (0.3, 1.7), 1: (2.5, 0.3, 1.7), 2: (2.0, 3.0, 0.3, 1.7)}[distributions.FAMILIES[family]]
    u = np.array([0.05, 0.4, 0.9])
    x = distributions.ppf(u, family, params)
    assert distributions.cdf(x, family, params) == pytest.approx(u, abs=1e-7)
    z = np.linspace(x[0], x[2], 20001)
    assert np.trapezoid(np.exp(distributions.log_pdf(z, family, params)), z) == pytest.approx(0.85, abs=1e-5)


@pytest.mark.parametrize("family", list(distributions.FAMILIES))
def test_survival_column_matches_numpy(spark, family):
    params = {0: (0.3, 1.7), 1: (2.5, 0.3, 1.7), 2: (2.0, 3.0, 0.3, 1.7)}[distributions.FAMILIES[family]]
    z = np.linspace(-6, 6, 41)
    got = frame(spark, z=z).select("z", distributions.survival(F.col("z"), family, params).alias("s")).toPandas().sort_values("z").s
    assert got.to_numpy() == pytest.approx(1 - distributions.cdf(z, family, params), abs=2e-7)


NUISANCES = {"cauchy": (), "rayleigh": (), "halfnorm": (), "pareto": (2.5,), "triang": (0.3,), "loguniform": (0.1, 10.0), "truncnorm": (-1.0, 2.0), "chi2": (3.0,)}
#: Medians of the standard families.
MEDIANS = {"cauchy": 0.0, "rayleigh": 1.17741002, "halfnorm": 0.67448975, "pareto": 1.31950791, "triang": 0.40839202, "loguniform": 1.0, "chi2": 2.36597388}


def test_nuisance_families_and_own_functions(spark):
    u = np.linspace(0.01, 0.99, 25)
    for family, shape in NUISANCES.items():
        z = distributions.ppf(u, family, (*shape, 1.0, 2.0))
        assert (np.diff(z) > 0).all()
        if family in MEDIANS:
            assert distributions.ppf(0.5, family, (*shape, 0.0, 1.0)) == pytest.approx(MEDIANS[family], abs=1e-6)
    z = distributions.ppf(0.5, "truncnorm", (-1.0, 2.0, 0.0, 1.0))
    assert special.norm_cdf(z) == pytest.approx((special.norm_cdf(-1.0) + special.norm_cdf(2.0)) / 2)
    own = lambda u, k: u**k
    assert distributions.ppf(0.5, own, (2.0, 1.0, 4.0)) == pytest.approx(2.0)
    got = frame(spark, u=u).select(distributions.ppf_column(F.col("u"), own, (2.0, 1.0, 4.0)).alias("z")).toPandas().z
    assert got.to_numpy() == pytest.approx(1 + 4 * u**2)
    r = np.random.default_rng(0)
    a, b = r.uniform(0, 10, 300), r.uniform(0, 1, 300)
    df = frame(spark, a=a, b=b, y=a + 3 * b + r.normal(0, 0.5, 300))
    args = (df, ["a", "b"], "y", integrate.poi_grid(df, ["a"]), ["a"], {"b": (0.0, 1.0)}, ("Polynomial", 1), 0.5, "norm", 8.0)
    curve = lambda dists: bootstrap.bootstrap_curves(*args, n_boot=4, n_mc=40, dists=dists).toPandas().groupby("grid_id").pod.mean().to_numpy()
    assert curve({"b": (own, (1.0, 0.0, 1.0))}) == pytest.approx(curve({"b": ("uniform", (0.0, 1.0))}), abs=1e-9)
    assert curve({"b": (own, (9.0, 0.0, 1.0))}).mean() < curve(None).mean()


def test_no_scale_is_null(spark):
    assert spark.range(1).select(distributions.survival(F.lit(0.0), "norm", (0.0, 0.0))).first()[0] is None


def test_ridge_matches_direct_solution(spark):
    r = np.random.default_rng(3)
    X, y = r.uniform(0, 10, (80, 2)), r.normal(0, 1, 80)
    y = y + X[:, 0] ** 2 - X[:, 1]
    fits = polynomial.fit_polynomials(frame(spark, a=X[:, 0], b=X[:, 1], y=y), ["a", "b"], "y", (1, 2, 3))
    for k in (1, 2, 3):
        m = fits.models["Polynomial", k]
        direct = polynomial.fit_arrays(X, y, ["a", "b"], k)
        assert m.predict(X) == pytest.approx(direct.predict(X), abs=1e-6)
    assert fits.winner[1] >= 2
    m = fits.models["Polynomial", 2]
    raw = sum(v * X[:, 0] ** t[0] * X[:, 1] ** t[1] for t, v in m.raw().items())
    assert raw == pytest.approx(m.predict(X), abs=1e-6)
    native = frame(spark, a=X[:, 0], b=X[:, 1]).select("a", m.column().alias("p")).toPandas()
    assert sorted(native.p) == pytest.approx(sorted(m.predict(X)), abs=1e-8)


def test_arrow_gram_matches_native(spark, monkeypatch):
    x, y = quadratic(spark)
    df = frame(spark, x=x, y=y)
    native = polynomial.fit_polynomials(df, ["x"], "y", (1, 2))
    monkeypatch.setattr(polynomial, "NATIVE_SUMS", 0)
    arrow = polynomial.fit_polynomials(df, ["x"], "y", (1, 2))
    assert native.cv_mse == pytest.approx(arrow.cv_mse)


def test_equation(spark):
    x, y = quadratic(spark)
    m = polynomial.fit_polynomials(frame(spark, Crack_L=x, y=y), ["Crack_L"], "y", (2,)).models["Polynomial", 2]
    text = polynomial.equation(m, "out_db")
    assert text.startswith(r"out\_db = ") and r"Crack\_L^{2}" in text


def test_local_std_matches_loop(spark):
    r = np.random.default_rng(5)
    X, e, G = r.uniform(0, 10, (150, 3)), r.normal(0, 0.5, 150), r.uniform(0, 10, (80, 3))
    w = np.exp(-((G[:, None] - X[None]) ** 2).sum(2) / (2 * 1.25**2))
    total = w.sum(1)
    want = np.sqrt(w @ e**2 / np.where(total <= 1e-12, 1e-10, total))
    names = ["a", "b", "c"]
    train = spark.createDataFrame(pd.DataFrame(X, columns=names).assign(residual=e))
    grid = spark.createDataFrame(pd.DataFrame(G, columns=names).assign(grid_id=range(80)))
    assert variance.local_std(grid, train, names, 1.25).toPandas().sort_values("grid_id").sigma.to_numpy() == pytest.approx(want, rel=1e-9)
    assert variance.smooth(X, e**2, G, 1.25) == pytest.approx(want, rel=1e-6)
    assert variance.local_std(grid, train, names, 0).first()["sigma"] is None


def test_noise_that_grows(spark):
    r = np.random.default_rng(1)
    x = np.linspace(0.1, 5, 300)
    df = frame(spark, x=x, y=3 * x + r.normal(0, 1, 300) * 0.2 * x)
    m = polynomial.fit_polynomials(df, ["x"], "y", (1,)).models["Polynomial", 1]
    train, h = variance.fit_variance_model(df, m, ["x"], "y")
    s = variance.local_std(frame(spark, grid_id=[0, 1], x=[0.5, 4.5]), train, ["x"], h).toPandas().sort_values("grid_id").sigma
    assert 0 < h <= 0.5 * 4.9 + 1e-6 and s.iloc[1] > 2 * s.iloc[0]


def test_bandwidth_uses_all_rows_beyond_a_block(spark):
    r = np.random.default_rng(2)
    x, z = r.uniform(0, 5, 400), r.uniform(0, 3, 400)
    train = frame(spark, x=x, z=z, residual=r.normal(0, 1, 400) * (0.2 + x))
    for names in (["x"], ["x", "z"]):
        whole = variance.optimise_bandwidth(train, names)
        assert variance.optimise_bandwidth(train, names, most=150) == pytest.approx(whole, abs=1e-4)
    e = train.toPandas()
    blocks = variance.packed_blocks(train.select("x", "z", "residual"), 400, 150)
    want = [variance.loo_error(e[["x", "z"]].to_numpy(), e.residual.to_numpy() ** 2, h) for h in (0.05, 1.0)]
    assert blocks.count() == 3 and variance.blocked_errors(blocks, 3, (0.05, 1.0)) / 400 == pytest.approx(want)


@pytest.mark.parametrize(("family", "draw"), [("norm", lambda r: r.normal(0, 1, 3000)), ("gumbel_r", lambda r: r.gumbel(0, 1, 3000)), ("uniform", lambda r: r.uniform(-1, 1, 3000)), ("laplace", lambda r: r.laplace(0, 1, 3000))])
def test_families_are_recognised(family, draw):
    assert errors.best_of(draw(np.random.default_rng(0)))[0] == family


def test_bad_residuals_give_the_default():
    assert errors.best_of(np.array([1.0, np.nan])) == ("norm", (0.0, 1.0))


def test_linear_model(spark):
    x = np.linspace(1, 10, 50)
    y = 2 * x + 1 + np.random.default_rng(0).normal(0, 0.5, 50)
    df = frame(spark, x=x, y=y)
    m = linear.fit_linear_a_hat_model(df, "x", "y")
    b, a = np.polyfit(x, y, 1)
    assert (m.slope, m.intercept) == pytest.approx((b, a)) and m.tau == pytest.approx(math.sqrt(((y - a - b * x) ** 2).sum() / 48))
    c = linear.compute_linear_pod_curve(linear.study_grid(df, "x"), "x", m, 15.0).toPandas().sort_values("grid_id")
    assert c.pod.is_monotonic_increasing and c.mean_response.is_monotonic_increasing and c.pod.between(0, 1).all()
    logs = linear.fit_linear_a_hat_model(frame(spark, x=x, y=np.exp(2 * np.log(x))), "x", "y", True, True)
    assert logs.slope == pytest.approx(2) and logs.intercept == pytest.approx(0, abs=1e-9)
    ci = reliability.confidence_bounds(linear.bootstrap_curves(df, linear.study_grid(df, "x"), "x", "y", 15.0, 40)).toPandas()
    assert len(ci) == 400 and ((0 <= ci.ci_lower) & (ci.ci_lower <= ci.ci_upper) & (ci.ci_upper <= 1)).all()
    weighted = linear.weighted_resamples(linear.axes(df, "x", "y", False, False), 200).toPandas()
    assert weighted.slope.mean() == pytest.approx(b, abs=0.02) and weighted.n.mean() == pytest.approx(50, abs=2)


def test_reliability_points(spark):
    c = frame(spark, grid_id=[0, 1, 2, 3], x=[0.0, 1.0, 2.0, 3.0], p=[0.2, 0.6, 0.5, 0.9])
    got = {r["target"]: r["x"] for r in reliability.reliability_points(c, "x", "p", [0.1, 0.6, 0.75, 0.95]).collect()}
    assert got[0.1] == 0.0 and got[0.6] == 1.0 and got[0.75] == pytest.approx(2.5) and got[0.95] is None


def test_interpolation(spark):
    xs, ys = F.array(*[F.lit(v) for v in (0.0, 1.0, 3.0)]), F.array(*[F.lit(v) for v in (1.0, 2.0, 6.0)])
    q = [-1.0, 0.5, 1.0, 2.0, 9.0]
    got = frame(spark, q=q).select("q", grids.interpolate(F.col("q"), xs, ys).alias("v")).toPandas().sort_values("q").v
    assert got.to_numpy() == pytest.approx(np.interp(q, [0, 1, 3], [1, 2, 6]))


def test_mesh_has_the_first_variable_slowest(spark):
    m = grids.mesh(spark, ("a", "b"), (0, 0), (1, 2), 3).orderBy("grid_id").collect()
    assert [(r["a"], r["b"]) for r in m[:4]] == [(0, 0), (0, 1), (0, 2), (0.5, 0)]


def test_marginal_pod_against_numpy(spark):
    r = np.random.default_rng(2)
    X = r.uniform(0, 10, (120, 2))
    y = 2 * X[:, 0] + X[:, 1] + r.normal(0, 0.5, 120)
    df = frame(spark, a=X[:, 0], b=X[:, 1], y=y)
    m = polynomial.fit_polynomials(df, ["a", "b"], "y", (1,)).models["Polynomial", 1]
    train = variance.add_residuals(df, m, "y")
    grid = frame(spark, grid_id=[0, 1, 2], a=[1.0, 5.0, 9.0])
    ranges = {"b": (0.0, 10.0)}
    got = integrate.compute_multi_dim_pod(grid, ranges, m, train, 1.5, ("norm", (0.0, 1.0)), [10.0, 20.0], n_mc=200).toPandas().sort_values(["threshold", "grid_id"])
    sample = integrate.nuisance_sample(spark, ranges, n=200).toPandas().b.to_numpy()
    res = y - m.predict(X)
    for t in (10.0, 20.0):
        for i, a in enumerate((1.0, 5.0, 9.0)):
            P = np.stack([np.full(200, a), sample], 1)
            s = variance.smooth(X, res**2, P, 1.5)
            want = (1 - special.norm_cdf((t - m.predict(P)) / s)).mean()
            assert got[(got.threshold == t) & (got.grid_id == i)].pod.iloc[0] == pytest.approx(want, abs=1e-5)
    fixed = integrate.compute_multi_dim_pod(grid, {"b": (5.0, 5.0)}, m, train, 1.5, ("norm", (0.0, 1.0)), 15.0).toPandas()
    assert len(fixed) == 3
    shifted = integrate.compute_multi_dim_pod(grid, ranges, m, train, 1.5, ("norm", (0.0, 1.0)), [10.0], {"b": ("norm", (9.0, 0.5))}, n_mc=200).toPandas()
    assert shifted.pod.mean() > got[got.threshold == 10].pod.mean()


def test_polynomial_bootstrap(spark):
    x, y = quadratic(spark)
    df = frame(spark, x=x, y=y)
    grid, calls = integrate.poi_grid(df, ["x"]), []
    ci = bootstrap.bootstrap_pod_ci(df, ["x"], "y", grid, ["x"], {}, ("Polynomial", 2), 0.5, "norm", 5.0, n_boot=20, progress=lambda a, b: calls.append((a, b)), levels=(90,)).toPandas()
    assert len(ci) == 100 and (ci.ci_lower <= ci.ci_upper).all() and calls[-1] == (20, 20)


def test_sobol_of_an_additive_model(spark):
    r = np.random.default_rng(4)
    X = r.uniform(0, 1, (200, 2))
    m = polynomial.fit_arrays(X, 2 * X[:, 0] + X[:, 1], ["a", "b"], 1, alpha=0.0)
    st = {r["variable"]: r["st"] for r in sobol.total_order(spark, m, {"a": (0, 1), "b": (0, 1)}).collect()}
    assert st["a"] == pytest.approx(0.8, abs=0.03) and st["b"] == pytest.approx(0.2, abs=0.03)


def test_kriging(spark):
    r = np.random.default_rng(0)
    x = np.linspace(0, 10, 60)
    y = 2 * x + r.normal(0, 0.2, 60)
    y[15] += 10
    model, mse, spec = kriging.fit_kriging(frame(spark, X=x, y=y), ["X"], "y", folds=4, restarts=0)
    assert model.gamma > 1 and mse < 10 and len(model.loo_residuals) == 60
    assert kriging.refit(spec, x[:, None], y, ["X"]).predict(x[:, None]) == pytest.approx(model.predict(x[:, None]), abs=1e-6)
    K = model.constant * kriging.correlation(model.kernel, model.X, model.X, model.scales, model.shape) + model.noise * np.eye(60)
    ones, keep = np.ones(59), np.arange(60) != 7
    Ki, k = np.linalg.inv(K[np.ix_(keep, keep)]), K[keep, 7]
    ys = model.X[:, 0] * 0 + y[np.argsort(x)]
    beta = ones @ Ki @ ys[keep] / (ones @ Ki @ ones)
    mean = beta + k @ Ki @ (ys[keep] - beta)
    var = K[7, 7] - k @ Ki @ k + (1 - ones @ Ki @ k) ** 2 / (ones @ Ki @ ones)
    assert model.loo_residuals[7] == pytest.approx((ys[7] - mean) / math.sqrt(var), abs=1e-5)
    assert kriging.fit_kriging(spark.range(1001).selectExpr("cast(id as double) x", "cast(id as double) y"), ["x"], "y") is None


def test_study(spark):
    r = np.random.default_rng(6)
    a, b = r.uniform(0, 10, 1100), r.uniform(0, 1, 1100)
    st = SimulationStudy(spark)
    st.add_data(frame(spark, a=a, b=b, y=3 * a + b + r.normal(0, 1, 1100), junk="x").select("a", "b", "y", "junk"), "y", ["a", "b"])
    with pytest.raises(ValueError, match="inputs"):
        st.pod("nope", 15.0)
    with pytest.raises(ValueError, match="one or two"):
        st.pod(["a", "b", "a"], 15.0)
    res = st.pod("a", 15.0, nuisance_col="b", n_boot=0)
    assert res.a90_95 is None and len(res.reliability) == 16 and 5 < res.reliability[90, 95] < 7
    assert res.model.kind == "Polynomial" and res.sobol["a"] > 0.9
    before = st._models
    st.compute_pod_spectrum("a", "b", n_thresholds=40)
    near = st.pod("a", 15.0, nuisance_col="b", n_boot=0)
    assert st._models is before and near.reliability[90, 95] == pytest.approx(res.reliability[90, 95], abs=0.2)
    with pytest.raises(ValueError, match="Kriging"):
        st.select_model("kriging")
    with pytest.raises(ValueError, match="degree"):
        st.select_model("polynomial", 99)
    assert {"signal", "pod", "model_selection", "threshold"} <= set(st.plot_data())
    lin = st.linear_pod("a", 15.0, n_boot=30)
    assert lin.a90_95 >= lin.reliability[90, 50] - 1e-9
    st.add_data(frame(spark, y=[1.0], b=[0.5], a=[0.1]))
    assert st._models is None and st.data.count() == 1101
    with pytest.raises(ValueError, match="missing"):
        st.add_data(frame(spark, a=[1.0]))
    assert estimate_seconds(0, 0, 0, "polynomial", None, False) == 0.0
    assert estimate_seconds(2000, 100, 1, "kriging", 4, True) > estimate_seconds(2000, 100, 1, "polynomial", 4, True)
    # As benchmarked: 40 replicates over 20,000 rows on eight cores took 58 s, and the marginal curve 8 s.
    # As timed on eight cores.
    assert estimate_seconds(20_000, 400, 0, "polynomial", 8, True) == pytest.approx(14, rel=0.5)
    assert estimate_seconds(20_000, 0, 1, "polynomial", 8, True) == pytest.approx(3.6, rel=0.5)
    assert estimate_seconds(20_000, 0, 0, "polynomial", 8, False) == pytest.approx(10, rel=0.5)
    assert estimate_seconds(20_000, 0, 0, "polynomial", 8, False) > estimate_seconds(20_000, 0, 0, "polynomial", 8, True)


def test_forecast_of_a_timed_run(spark):
    r = np.random.default_rng(8)
    x, z = r.uniform(1, 9, 2000), r.uniform(0, 1, 2000)
    st = SimulationStudy(spark)
    st.add_data(frame(spark, x=x, z=z, y=2 * x + z + r.normal(0, 1, 2000)), "y", ["x", "z"])
    args = {"slice_values": {"z": 0.5}, "model_override": "polynomial", "force_degree": 1}
    st.pod("x", 9.0, n_boot=0, **args).curve.collect()  # fits the models
    forecast, began = st.estimate_compute_time("polynomial", 200, n_jobs=4), time.perf_counter()
    out = st.pod("x", 9.5, n_boot=200, **args)
    out.curve.collect(), out.ci.collect()
    spent = time.perf_counter() - began
    assert spent / 4 < forecast < 4 * spent  # a factor of about 3, and some for a busy machine


def test_stream(spark, tmp_path):
    from detectra.streaming import ingest

    src = str(tmp_path / "in")
    frame(spark, a=[str(i) for i in range(12)] + ["bad"], y=np.arange(13.0)).write.parquet(src)
    stream = spark.readStream.schema("a string, y double").parquet(src)
    ingest.append_runs(stream, ["a"], "y", str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    st = SimulationStudy(spark, ["a"], "y")
    ingest.feed_study(stream, st, str(tmp_path / "c2")).awaitTermination(60)
    assert st.data.count() == 13 and st._validate().count() == 12


@pytest.mark.parametrize("d", [1, 2, 3])
def test_smoothing_on_a_lattice(d):
    r = np.random.default_rng(5)
    X, points = r.random((900, d)), r.random((80, d))
    r2 = (1 + X[:, 0]) ** 2 * r.random(900)
    for h in (0.03, 0.1, 2.0):
        assert np.allclose(variance.smooth_binned(X, r2, points, h), variance.smooth(X, r2, points, h), rtol=3e-3)
    assert np.allclose(variance.smooth_binned(np.ones((5, d)), np.full(5, 4.0), np.ones((1, d)), 0.1), 2.0)
