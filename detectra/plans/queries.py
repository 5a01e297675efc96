"""The registered queries over the study tables, and their SQL where SQL can express them."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions, draws, sequences, text
from ..operators import adaptive, bootstrap, coverage, design, errors, exports, integrate, kriging, linear, polynomial, reliability, sobol, sufficiency, validate, variance
from ..operators.executors import CLIExecutor, PythonExecutor
from ..sources import checkpoint, csv, tables
from ..sources.tables import ORDER_SQL, PART_SQL, USER_SQL
from .study import SimulationStudy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BANDWIDTH, THRESHOLD = 80.0, 1_500_000.0
LADDER = (40.0, 80.0, 160.0)
NAMES = ("a", "n", "disc", "tax")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Validation and summaries

DIRTY_SQL = "CASE WHEN event_id % 97 = 0 THEN 'bad' WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN 'NaN' WHEN event_id % 107 = 0 THEN '1d' ELSE CAST(value AS VARCHAR) END"
DIRTY_TEST = "(event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0 OR event_id % 107 = 0)"


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", F.expr(DIRTY_SQL.replace("VARCHAR", "STRING")).alias("value"))


@query(f"SELECT CAST(event_id AS DOUBLE) AS event_id, round(value, 6) AS value FROM events WHERE NOT {DIRTY_TEST}")
def validate_clean(spark, sf_dir):
    return rounded(validate.validate_simulation(dirty_events(spark, sf_dir), ["event_id"], "value")[0], 6)


@query(f"SELECT event_id, {DIRTY_SQL} AS value FROM events WHERE {DIRTY_TEST}")
def validate_removed(spark, sf_dir):
    return validate.validate_simulation(dirty_events(spark, sf_dir), ["event_id"], "value")[1]


SUMMARY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) AS n_total, count({c}) AS n_valid, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(median({c}) AS DOUBLE), 4) AS median, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM lineitem" for c in SUMMARY))
def summary_stats(spark, sf_dir):
    return rounded(validate.summary_statistics(tables.table(spark, sf_dir, "lineitem"), SUMMARY))


@query("SELECT round(min(o_totalprice), 4) AS min, round(median(o_totalprice), 4) AS median, round(max(o_totalprice), 4) AS max FROM orders")
def data_summary(spark, sf_dir):
    s = validate.data_summary(tables.table(spark, sf_dir, "orders"), "o_totalprice")
    return rounded(spark.createDataFrame([tuple(s.values())], "min double, median double, max double"))


def gap_sql(source: str, names) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM s" for c in names)
    return f"""WITH s AS ({source}), v AS ({each}),
        g AS (SELECT variable, x, lead(x) OVER (PARTITION BY variable ORDER BY x) AS nxt FROM v),
        r AS (SELECT variable, x, nxt, nxt - x AS gap, row_number() OVER (PARTITION BY variable ORDER BY nxt - x DESC NULLS LAST, x) AS k FROM g),
        b AS (SELECT variable, min(x) AS lo, max(x) AS hi FROM v GROUP BY variable)"""


@query(gap_sql(PART_SQL, NAMES) + " SELECT b.variable, round(lo, 4) AS lo, round(hi, 4) AS hi, round(CASE WHEN hi > lo THEN gap / (hi - lo) ELSE 0 END, 3) AS max_gap_ratio, CASE WHEN hi > lo THEN gap / (hi - lo) < 0.2 ELSE TRUE END AS sufficient FROM r JOIN b ON r.variable = b.variable WHERE k = 1")
def coverage_gap(spark, sf_dir):
    out = coverage.coverage(tables.part_study(spark, sf_dir), NAMES)
    return rounded(out.withColumn("max_gap_ratio", F.round("max_gap_ratio", 3)))


@query(gap_sql("SELECT c_acctbal FROM customer", ["c_acctbal"]) + " SELECT b.variable, round(lo, 4) AS lo, round(hi, 4) AS hi, round(gap, 4) AS gap, round(x, 4) AS gap_start, round(nxt, 4) AS gap_end FROM r JOIN b ON r.variable = b.variable WHERE k = 1")
def largest_gap(spark, sf_dir):
    return rounded(coverage.gaps(tables.table(spark, sf_dir, "customer"), ["c_acctbal"]))


@query(f"WITH s AS ({PART_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM s" for a in NAMES for b in NAMES))
def correlation_matrix(spark, sf_dir):
    return rounded(validate.correlation_matrix(tables.part_study(spark, sf_dir), NAMES), 6)


@query(f"WITH s AS ({PART_SQL}), r AS (SELECT corr(a, n) AS c FROM s) SELECT 'a' AS variable, round(1 / (1 - c * c), 4) AS vif FROM r UNION ALL SELECT 'n', round(1 / (1 - c * c), 4) FROM r")
def vif_two_inputs(spark, sf_dir):
    v = sufficiency.vif(tables.part_study(spark, sf_dir), ["a", "n"])
    return spark.createDataFrame(list(v.items()), "variable string, vif double")


def det_sql(rows: list[int], cols: list[int]) -> str:
    """The determinant of the named rows and columns of the correlation matrix c."""
    if not rows:
        return "1e0"
    terms = [f"{'-' if k % 2 else '+'} c[{rows[0] + 1}][{x + 1}] * ({det_sql(rows[1:], [y for y in cols if y != x])})" for k, x in enumerate(cols)]
    return "(0e0 " + " ".join(terms) + ")"


def vif_sql() -> str:
    every = list(range(len(NAMES)))
    rest = lambda i: [j for j in every if j != i]
    matrix = ", ".join("[" + ", ".join("1e0" if x == y else f"corr({x}, {y})" for y in NAMES) + "]" for x in NAMES)
    return f"WITH s AS ({PART_SQL}), r AS (SELECT [{matrix}] AS c FROM s) " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round({det_sql(rest(i), rest(i))} / {det_sql(every, every)}, 4) AS vif FROM r" for i, c in enumerate(NAMES))


@query(vif_sql())
def vif_matrix(spark, sf_dir):
    v = sufficiency.vif(tables.part_study(spark, sf_dir), list(NAMES))
    return spark.createDataFrame(list(v.items()), "variable string, vif double")


# Linear model


def fit_sql(source: str, x: str = "a", y: str = "signal") -> str:
    return f"f AS (SELECT regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, sqrt(greatest(regr_syy({y}, {x}) - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x}), 0) / (count(*) - 2)) AS tau FROM {source})"


@query(f"WITH s AS ({ORDER_SQL}), {fit_sql('s')} SELECT round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(tau, 3) AS tau FROM f")
def linear_fit(spark, sf_dir):
    m = linear.fit_linear_a_hat_model(tables.order_study(spark, sf_dir), "a", "signal")
    return spark.createDataFrame([(round(m.slope, 4), round(m.intercept, 3), round(m.tau, 3))], "slope double, intercept double, tau double")


@query(f"WITH s AS ({ORDER_SQL}), l AS (SELECT ln(a) AS x, ln(signal) AS y FROM s), {fit_sql('l', 'x', 'y')} SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(tau, 6) AS tau FROM f")
def linear_fit_loglog(spark, sf_dir):
    m = linear.fit_linear_a_hat_model(tables.order_study(spark, sf_dir), "a", "signal", True, True)
    return spark.createDataFrame([(round(m.slope, 6), round(m.intercept, 6), round(m.tau, 6))], "slope double, intercept double, tau double")


LINE_SQL = "SELECT i AS grid_id, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99e0) END AS a FROM (SELECT min(a) AS lo, max(a) AS hi FROM s), (SELECT range AS i FROM range(100))"
CURVE_SQL = f"""WITH s AS ({ORDER_SQL}), {fit_sql('s')}, g AS ({LINE_SQL}),
    z AS (SELECT grid_id, a, intercept + slope * a AS m, (200000e0 - (intercept + slope * a)) / tau AS z FROM g, f),
    c AS (SELECT grid_id, a, m, 1e0 - {distributions.norm_cdf_sql('z')} AS pod FROM z)"""


@query(CURVE_SQL + " SELECT grid_id, round(a, 6) AS a, round(m, 3) AS mean_response, round(pod, 6) AS pod FROM c")
def linear_pod_curve(spark, sf_dir):
    s = tables.order_study(spark, sf_dir)
    c = linear.compute_linear_pod_curve(linear.study_grid(s, "a"), "a", linear.fit_linear_a_hat_model(s, "a", "signal"), 200_000.0)
    return c.select("grid_id", F.round("a", 6).alias("a"), F.round("mean_response", 3).alias("mean_response"), F.round("pod", 6).alias("pod"))


REACH_SQL = """, e AS (SELECT {by} grid_id, a, max({v}) OVER ({part} ORDER BY grid_id) AS y FROM {t}),
    st AS (SELECT {by} grid_id, a, y, lag(a) OVER ({part} ORDER BY grid_id) AS a0, lag(y) OVER ({part} ORDER BY grid_id) AS y0 FROM e),
    h AS (SELECT {by} target, grid_id, CASE WHEN y0 IS NULL OR y = y0 THEN a ELSE a0 + (a - a0) * (target - y0) / (y - y0) END AS xat FROM st, (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS target) WHERE y >= target),
    k AS (SELECT {by} target, xat, row_number() OVER (PARTITION BY {by} target ORDER BY grid_id) AS r FROM h)"""


@query(CURVE_SQL + REACH_SQL.format(by="", v="pod", part="", t="c") + " SELECT CAST(t.target AS DOUBLE) AS target, round(k.xat, 4) AS a FROM (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS target) t LEFT JOIN k ON k.target = t.target AND r = 1")
def linear_reliability(spark, sf_dir):
    s = tables.order_study(spark, sf_dir)
    c = linear.compute_linear_pod_curve(linear.study_grid(s, "a"), "a", linear.fit_linear_a_hat_model(s, "a", "signal"), 200_000.0)
    return rounded(reliability.reliability_points(c, "a", "pod"))


REPLICATES = 50
BOOT_SQL = f"""WITH s AS ({USER_SQL}), nn AS (SELECT count(*) AS n FROM s),
    num AS (SELECT row_number() OVER (ORDER BY a, signal) - 1 AS i, a, signal FROM s),
    d AS (SELECT b, {draws.bits_sql("'0'", 'b', 'k')} % n AS i FROM (SELECT range AS b FROM range({REPLICATES})), (SELECT unnest(range(n)) AS k, n FROM nn)),
    f AS (SELECT b, regr_slope(signal, a) AS slope, regr_intercept(signal, a) AS intercept, sqrt(greatest(regr_syy(signal, a) - regr_sxy(signal, a) * regr_sxy(signal, a) / regr_sxx(signal, a), 0) / (count(*) - 2)) AS tau FROM d JOIN num ON d.i = num.i GROUP BY b),
    g AS ({LINE_SQL}),
    z AS (SELECT b, grid_id, (3000e0 - (intercept + slope * a)) / tau AS z FROM g, f),
    c AS (SELECT b, grid_id, 1e0 - {distributions.norm_cdf_sql('z')} AS pod FROM z),
    ci AS (SELECT grid_id, unnest([50, 90, 95, 99]) AS level, unnest([quantile_cont(pod, 0.25), quantile_cont(pod, 0.05), quantile_cont(pod, 0.025), quantile_cont(pod, 0.005)]) AS lo, unnest([quantile_cont(pod, 0.75), quantile_cont(pod, 0.95), quantile_cont(pod, 0.975), quantile_cont(pod, 0.995)]) AS hi FROM c GROUP BY grid_id)"""


def boot(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = tables.user_study(spark, sf_dir)
    grid = linear.study_grid(s, "a")
    return grid, reliability.confidence_bounds(linear.bootstrap_curves(s, grid, "a", "signal", 3000.0, REPLICATES))


@query(BOOT_SQL + " SELECT grid_id, level, round(lo, 5) AS ci_lower, round(hi, 5) AS ci_upper FROM ci")
def linear_bootstrap_ci(spark, sf_dir):
    return rounded(boot(spark, sf_dir)[1], 5)


@query(BOOT_SQL + ", cg AS (SELECT level, ci.grid_id, g.a, lo FROM ci JOIN g ON ci.grid_id = g.grid_id)" + REACH_SQL.format(by="level,", v="lo", part="PARTITION BY level", t="cg") + " SELECT l.level, CAST(t.target AS DOUBLE) AS target, round(k.xat, 3) AS a FROM (SELECT unnest([50, 90, 95, 99]) AS level) l CROSS JOIN (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS target) t LEFT JOIN k ON k.level = l.level AND k.target = t.target AND r = 1")
def reliability_table(spark, sf_dir):
    grid, ci = boot(spark, sf_dir)
    return rounded(reliability.reliability_table(ci, grid, "a"), 3)


POISSON_SQL = f"""WITH s AS ({ORDER_SQL}), d AS (SELECT b, a, signal, {draws.uniform_sql("'0'", "b", "id")} AS u FROM s, (SELECT range AS b FROM range(20))),
    p AS (SELECT b, a, signal, {" + ".join(f"CASE WHEN u > {c!r} THEN 1e0 ELSE 0e0 END" for c in linear.POISSON_CUTS)} AS w FROM d),
    g AS (SELECT b, sum(w) AS n, sum(w * a) AS sx, sum(w * signal) AS sy, sum(w * a * a) AS xx, sum(w * a * signal) AS xy, sum(w * signal * signal) AS yy FROM p GROUP BY b),
    f AS (SELECT b, n, sx, sy, (xy - sx * sy / n) / (xx - sx * sx / n) AS slope, xy - sx * sy / n AS sxy, yy - sy * sy / n AS syy FROM g)
    SELECT b AS replicate, round(slope, 2) AS slope, round((sy - slope * sx) / n, 1) AS intercept, round(sqrt(greatest(syy - slope * sxy, 0) / greatest(n - 2, 0)), 1) AS tau, n FROM f"""


@query(POISSON_SQL)
def linear_bootstrap_poisson(spark, sf_dir):
    rows = linear.axes(tables.order_study(spark, sf_dir), "a", "signal", False, False, "id")
    out = linear.weighted_resamples(rows, 20)
    return out.select("replicate", F.round("slope", 2).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("tau", 1).alias("tau"), "n")


# Polynomial models

FOLD_SQL = f"{draws.bits_sql(chr(39) + '42' + chr(39), 'id')} % 10"
RIDGE_SQL = "count(*) AS n, avg(a) AS xm, avg(signal) AS ym, stddev_pop(a) AS sx, covar_pop(a, signal) AS cxy"


def line_of(t: str) -> str:
    """Slope and intercept of the ridge with penalty 0.1 on the standardised input."""
    return f"(cxy / sx) / (1 + 0.1e0 / {t}.n) / sx AS slope, ym - (cxy / sx) / (1 + 0.1e0 / {t}.n) / sx * xm AS intercept"


def part_fits(spark, sf_dir, degrees=(1, 2, 3)):
    return polynomial.fit_polynomials(tables.part_study(spark, sf_dir), ["a"], "signal", degrees, row_id="id")


@query(f"WITH s AS ({PART_SQL}), r AS (SELECT {RIDGE_SQL} FROM s), l AS (SELECT {line_of('r')} FROM r) SELECT round(slope, 4) AS slope, round(intercept, 2) AS intercept FROM l")
def poly_fit_d1(spark, sf_dir):
    raw = part_fits(spark, sf_dir, (1,)).models["Polynomial", 1].raw()
    return spark.createDataFrame([(round(float(raw[(1,)]), 4), round(float(raw[(0,)]), 2))], "slope double, intercept double")


@query(
    f"""WITH s AS (SELECT *, {FOLD_SQL} AS fold FROM ({PART_SQL})),
    r AS (SELECT k AS fold, {RIDGE_SQL} FROM s, (SELECT range AS k FROM range(10)) WHERE s.fold <> k GROUP BY k),
    l AS (SELECT fold, {line_of('r')} FROM r),
    e AS (SELECT s.fold, avg((signal - intercept - slope * a) * (signal - intercept - slope * a)) AS mse FROM s JOIN l ON s.fold = l.fold GROUP BY s.fold)
    SELECT 1 AS degree, round(sqrt(avg(mse)), 2) AS rmse FROM e"""
)
def poly_cv_d1(spark, sf_dir):
    return spark.createDataFrame([(1, round(float(np.sqrt(part_fits(spark, sf_dir, (1,)).cv_mse["Polynomial", 1])), 2))], "degree int, rmse double")


@query()
def poly_fit_multi(spark, sf_dir):
    fits = polynomial.fit_polynomials(tables.part_study(spark, sf_dir), list(NAMES), "signal", (1, 2, 3), row_id="id")
    m = fits.models[fits.winner]
    return spark.createDataFrame([(fits.winner[1], polynomial.equation(m, "signal"), polynomial.equation(m, "signal", raw=True))], "degree int, equation string, raw_equation string")


def elimination_sql(n: int, name: str = "e") -> list[str]:
    """CTEs e1 to en that solve n equations of columns m<row><column>, the right side in column n, from e0 on.

    Rows and columns are letters from the eleventh on.
    """
    k = DIGITS
    out = []
    for p in range(n):
        new = [f"m{k[p]}{k[j]} / m{k[p]}{k[p]} AS m{k[p]}{k[j]}" if i == p else f"m{k[i]}{k[j]} - m{k[i]}{k[p]} / m{k[p]}{k[p]} * m{k[p]}{k[j]} AS m{k[i]}{k[j]}" for i in range(n) for j in range(n + 1)]
        out.append(f"{name}{p + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(new)}) FROM {name}{p})")
    return out


DIGITS = "0123456789abcdef"


def ridge_cv_sql(degrees) -> str:
    """Mean fold MSE of the ridge of each degree, each fitted to the other folds."""
    top, z = max(degrees), DIGITS
    ctes = [
        f"s AS (SELECT *, {FOLD_SQL} AS fold FROM ({PART_SQL}))",
        "z AS (SELECT fold, signal, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x FROM s)",
        f"f AS MATERIALIZED (SELECT fold, signal, {', '.join(' * '.join(['x'] * (i + 1)) + f' AS t{i}' for i in range(top))} FROM z)",
    ]
    for d in degrees:
        k = range(d)
        cells = [f"CASE WHEN {i} = {j} THEN 1e0 + 0.1e0 / count(*) ELSE corr(t{i}, t{j}) END AS m{z[i]}{z[j]}" for i in k for j in k]
        cells += [f"covar_pop(t{i}, signal) / stddev_pop(t{i}) AS m{z[i]}{z[d]}, avg(t{i}) AS u{i}, stddev_pop(t{i}) AS d{i}" for i in k]
        mean = "ym + " + " + ".join(f"m{z[i]}{z[d]} / d{i} * (t{i} - u{i})" for i in k)
        ctes.append(f"g{d}_0 AS MATERIALIZED (SELECT k, {', '.join(cells)}, avg(signal) AS ym FROM f, (SELECT range AS k FROM range(10)) WHERE fold <> k GROUP BY k)")
        ctes += elimination_sql(d, f"g{d}_")
        ctes.append(f"r{d} AS (SELECT avg(e) AS mse FROM (SELECT avg(pow(signal - ({mean}), 2)) AS e FROM f JOIN g{d}_{d} ON fold = k GROUP BY k))")
    ctes.append("c AS (" + " UNION ALL ".join(f"SELECT {d} AS degree, mse FROM r{d}" for d in degrees) + ")")
    return f"WITH {', '.join(ctes)} SELECT degree, round(ln(mse), 6) AS log_mse, round(mse / min(mse) OVER (), 6) AS ratio FROM c"


def cubic_sql() -> str:
    """Each fold's R2 of the cubic fitted to the other folds."""
    k = range(3)
    cells = [f"corr(t{i}, t{j}) AS m{i}{j}" for i in k for j in k] + [f"covar_pop(t{i}, signal) / stddev_pop(t{i}) AS m{i}3, avg(t{i}) AS u{i}, stddev_pop(t{i}) AS d{i}" for i in k]
    mean = "ym + " + " + ".join(f"m{i}3 / d{i} * (t{i} - u{i})" for i in k)
    ctes = [
        f"s AS (SELECT *, {FOLD_SQL} AS fold FROM ({PART_SQL}))",
        "z AS (SELECT fold, signal, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS x FROM s)",
        "f AS (SELECT fold, signal, x AS t0, x * x AS t1, x * x * x AS t2 FROM z)",
        f"e0 AS (SELECT k, {', '.join(cells)}, avg(signal) AS ym FROM f, (SELECT range AS k FROM range(10)) WHERE fold <> k GROUP BY k)",
        *elimination_sql(3),
        f"r AS (SELECT k, 1 - avg(pow(signal - ({mean}), 2)) / var_pop(signal) AS r2 FROM f JOIN e3 ON fold = k GROUP BY k)",
    ]
    return f"WITH {', '.join(ctes)} SELECT round(avg(r2), 6) AS mean_r2, avg(r2) > 0.5 AS stable FROM r"


@query(ridge_cv_sql(polynomial.DEGREES))
def poly_cv_scores(spark, sf_dir):
    fits = part_fits(spark, sf_dir, polynomial.DEGREES)
    return exports.model_selection(fits.cv_mse, spark).select("degree", F.round(F.log("mse"), 6).alias("log_mse"), F.round("ratio", 6).alias("ratio"))


@query(cubic_sql())
def model_fit_r2(spark, sf_dir):
    r2 = sufficiency.model_fit(tables.part_study(spark, sf_dir), ["a"], "signal", "id")
    return spark.createDataFrame([(round(r2, 6), r2 > 0.5)], "mean_r2 double, stable boolean")


@query()
def sufficiency_report(spark, sf_dir):
    return sufficiency.sample_sufficiency(tables.part_study(spark, sf_dir), ["a", "disc"], "signal")


@query()
def bootstrap_convergence_trace(spark, sf_dir):
    return sufficiency.convergence_trace(tables.part_study(spark, sf_dir), ["a"], "signal")


TRACE_SQL = """WITH t AS (SELECT c_custkey AS replicate, c_nationkey % 3 AS probe, c_acctbal AS p FROM customer),
    w AS (SELECT replicate, coalesce(stddev_pop(p) OVER x, 0) / (abs(avg(p) OVER x) + 1e-6) AS width FROM t WINDOW x AS (PARTITION BY probe ORDER BY replicate ROWS UNBOUNDED PRECEDING))
    SELECT replicate, round(avg(width), 4) AS avg_width, round(max(width), 4) AS max_width FROM w GROUP BY replicate"""


@query(TRACE_SQL)
def running_spread(spark, sf_dir):
    t = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("replicate"), (F.col("c_nationkey") % 3).alias("probe"), F.col("c_acctbal").alias("prediction"))
    return rounded(reliability.convergence_trace(t))


# Noise

TRAIN_SQL = f"s AS ({PART_SQL}), r AS (SELECT {RIDGE_SQL} FROM s), l AS (SELECT {line_of('r')} FROM r), t AS (SELECT id, a, signal, signal - intercept - slope * a AS residual FROM s, l)"


def train(spark, sf_dir):
    m = part_fits(spark, sf_dir, (1,)).models["Polynomial", 1]
    return m, variance.add_residuals(tables.part_study(spark, sf_dir), m, "signal")


@query(f"WITH {TRAIN_SQL} SELECT id, round(residual, 2) AS residual FROM t")
def residuals(spark, sf_dir):
    return train(spark, sf_dir)[1].select("id", F.round("residual", 2).alias("residual"))


SIGMA_SQL = f"""g AS ({LINE_SQL}),
    k AS (SELECT grid_id, g.a, sum(exp(-((g.a - t.a) * (g.a - t.a)) / {2 * BANDWIDTH * BANDWIDTH}e0)) AS w, sum(exp(-((g.a - t.a) * (g.a - t.a)) / {2 * BANDWIDTH * BANDWIDTH}e0) * residual * residual) AS v FROM g, t GROUP BY grid_id, g.a),
    sg AS (SELECT grid_id, a, sqrt(v / CASE WHEN w <= 1e-12 THEN 1e-10 ELSE w END) AS sigma FROM k)"""


@query(f"WITH {TRAIN_SQL}, {SIGMA_SQL} SELECT grid_id, round(sigma, 2) AS sigma FROM sg")
def local_std(spark, sf_dir):
    _, t = train(spark, sf_dir)
    return rounded(variance.local_std(integrate.poi_grid(t, ["a"]), t, ["a"], BANDWIDTH), 2)


LADDER_SQL = ", ".join(f"sum(CASE WHEN x.id <> y.id THEN exp(-((x.a - y.a) * (x.a - y.a)) / {2 * h * h}e0) END) AS w{i}, sum(CASE WHEN x.id <> y.id THEN exp(-((x.a - y.a) * (x.a - y.a)) / {2 * h * h}e0) * y.residual * y.residual END) AS v{i}" for i, h in enumerate(LADDER))


@query(
    f"WITH {TRAIN_SQL}, p AS (SELECT x.id, x.residual * x.residual AS r2, {LADDER_SQL} FROM t x, t y GROUP BY x.id, x.residual), e AS (SELECT {', '.join(f'avg((r2 - v{i} / CASE WHEN w{i} <= 1e-12 THEN 1e-10 ELSE w{i} END) * (r2 - v{i} / CASE WHEN w{i} <= 1e-12 THEN 1e-10 ELSE w{i} END)) AS e{i}' for i in range(len(LADDER)))} FROM p) "
    + " UNION ALL ".join(f"SELECT {h}e0 AS bandwidth, round(ln(e{i}), 6) AS log_error FROM e" for i, h in enumerate(LADDER))
)
def bandwidth_ladder(spark, sf_dir):
    _, t = train(spark, sf_dir)
    return variance.bandwidth_errors(t, ["a"], LADDER).select("bandwidth", F.round(F.log("error"), 6).alias("log_error"))


@query()
def bandwidth_optimum(spark, sf_dir):
    _, t = train(spark, sf_dir)
    return spark.createDataFrame([(float(variance.optimise_bandwidth(t, ["a"])),)], "bandwidth double")


# Error distributions

AIC_SQL = """WITH a AS (SELECT count(value) AS n, avg(value) AS m, stddev_pop(value) AS s, median(value) AS med, min(value) AS lo, max(value) AS hi FROM events),
    b AS (SELECT avg(abs(value - med)) AS b FROM events, a)
    SELECT 'norm' AS family, round(m, 4) AS loc, round(s, 4) AS scale, round(4 + n * (ln(2 * pi() * s * s) + 1), 3) AS aic FROM a
    UNION ALL SELECT 'expon', round(lo, 4), round(m - lo, 4), round(4 + 2 * n * (ln(m - lo) + 1), 3) FROM a
    UNION ALL SELECT 'laplace', round(med, 4), round(b, 4), round(4 + 2 * n * (ln(2 * b) + 1), 3) FROM a, b
    UNION ALL SELECT 'uniform', round(lo, 4), round(hi - lo, 4), round(4 + 2 * n * ln(hi - lo), 3) FROM a"""


@query(AIC_SQL)
def dist_aic_closed(spark, sf_dir):
    out = errors.closed_form_fits(tables.table(spark, sf_dir, "events"), "value")
    return out.select("family", F.round("loc", 4).alias("loc"), F.round("scale", 4).alias("scale"), F.round("aic", 3).alias("aic"))


@query()
def dist_infer(spark, sf_dir):
    t = tables.user_study(spark, sf_dir).select("id", (F.col("signal") / F.col("a")).alias("residual"))
    family, params = errors.infer_best_distribution(t, t.select("id", F.lit(1.0).alias("sigma")), "id")
    return spark.createDataFrame([(family, [float(p) for p in params])], "family string, params array<double>")


#: g, g', g'' of log densities of two parameters in x, as likelihood.kernel has them.
SCORES = {
    "gumbel_r": ("-x - exp(-x)", "exp(-x) - 1e0", "-exp(-x)"),
    "logistic": ("-x - 2e0 * ln(1e0 + exp(-x))", "2e0 / (1e0 + exp(x)) - 1e0", "-2e0 * exp(x) / ((1e0 + exp(x)) * (1e0 + exp(x)))"),
}


def newton_sql(steps: int = 12) -> str:
    """Newton steps of the score equations in (loc, log scale), each a query over all rows."""
    parts = ["e AS (SELECT CAST(value AS DOUBLE) AS z FROM events WHERE value IS NOT NULL)", "m AS (SELECT count(*) AS n, avg(z) AS m, stddev_pop(z) AS s FROM e)"]
    ends = []
    for f, kernel, sign, loc, scale in (("gumbel_r", "gumbel_r", "", "m - 0.5772e0 * s * sqrt(6e0) / pi()", "s * sqrt(6e0) / pi()"), ("gumbel_l", "gumbel_r", "-", "-m - 0.5772e0 * s * sqrt(6e0) / pi()", "s * sqrt(6e0) / pi()"), ("logistic", "logistic", "", "m", "s * sqrt(3e0) / pi()")):
        g, g1, g2 = SCORES[kernel]
        parts.append(f"{f}_0 AS (SELECT {loc} AS loc, ln({scale}) AS ls FROM m)")
        for i in range(steps):
            parts.append(f"{f}_s{i} AS (SELECT loc, ls, exp(ls) AS s, ({sign}z - loc) / exp(ls) AS x FROM e, {f}_{i})")
            parts.append(
                f"{f}_t{i} AS (SELECT loc, ls, -sum({g1}) / s AS a, -count(*) - sum(x * ({g1})) AS b, sum({g2}) / (s * s) AS aa, (sum({g1}) + sum(x * ({g2}))) / s AS ab, sum(x * ({g1})) + sum(x * x * ({g2})) AS bb FROM {f}_s{i} GROUP BY loc, ls, s)"
            )
            parts.append(f"{f}_{i + 1} AS (SELECT loc - (bb * a - ab * b) / (aa * bb - ab * ab) AS loc, ls - (aa * b - ab * a) / (aa * bb - ab * ab) AS ls FROM {f}_t{i})")
        end = f"SELECT loc, ls, ({sign}z - loc) / exp(ls) AS x FROM e, {f}_{steps}"
        ends.append(f"SELECT '{f}' AS family, round({sign}loc, 4) AS loc, round(exp(ls), 4) AS scale, round(4e0 - 2e0 * (sum({g}) - count(*) * ls), 3) AS aic FROM ({end}) GROUP BY loc, ls")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(ends)


@query(newton_sql())
def dist_fits_newton(spark, sf_dir):
    """Families of two parameters whose maximum likelihood has no closed form."""
    e = tables.table(spark, sf_dir, "events").filter("value is not null").select(F.col("value").cast("double").alias("z"))
    fits = [(f, *map(float, p), float(a)) for f, p, a in errors.all_fits(e, "z", ("gumbel_r", "gumbel_l", "logistic"))]
    return spark.createDataFrame(fits, "family string, loc double, scale double, aic double").select("family", F.round("loc", 4).alias("loc"), F.round("scale", 4).alias("scale"), F.round("aic", 3).alias("aic"))


Z_SQL = "m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), g AS (SELECT event_id, (value - m) / s AS z FROM events, m)"


def standardised(spark, sf_dir) -> DataFrame:
    """(event_id, z): values of the events in deviations from their mean."""
    e = tables.table(spark, sf_dir, "events")
    one = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))  # one row
    return e.crossJoin(F.broadcast(one)).select("event_id", ((F.col("value") - F.col("m")) / F.col("s")).alias("z"))


SURVIVAL_SQL = {
    "norm": f"1e0 - {distributions.norm_cdf_sql('z')}",
    "gumbel_r": "1e0 - exp(-exp(-z))",
    "gumbel_l": "exp(-exp(z))",
    "logistic": "1e0 / (1e0 + exp(z))",
    "laplace": "CASE WHEN z < 0 THEN 1e0 - 0.5e0 * exp(z) ELSE 0.5e0 * exp(-z) END",
    "expon": "CASE WHEN z < 0 THEN 1e0 ELSE exp(-z) END",
    "uniform": "least(greatest(1e0 - z, 0e0), 1e0)",
    "weibull_min": "CASE WHEN z <= 0 THEN 1e0 ELSE exp(-pow(z, 1.5e0)) END",
    "weibull_max": "CASE WHEN z >= 0 THEN 0e0 ELSE 1e0 - exp(-pow(-z, 1.5e0)) END",
}


def _survival(family: str) -> None:
    params = (1.5, 0.0, 1.0) if family.startswith("weibull") else (0.0, 1.0)

    def run(spark, sf_dir):
        z = standardised(spark, sf_dir)
        return z.select("event_id", F.round("z", 5).alias("z"), F.round(distributions.survival(F.col("z"), family, params), 5).alias("sf"))

    run.__name__ = f"survival_{family}"
    query(f"WITH {Z_SQL} SELECT event_id, round(z, 5) AS z, round({SURVIVAL_SQL[family]}, 5) AS sf FROM g")(run)


for _family in SURVIVAL_SQL:
    _survival(_family)


@query(
    f"""WITH {Z_SQL} SELECT event_id, round(CASE WHEN z <= 0 THEN 1e0 ELSE exp(-z) * (1e0 + z) END, 5) AS gamma,
    round(0.5e0 - 0.375e0 * z / sqrt(1e0 + z * z / 4e0) * (1e0 - z * z / (1e0 + z * z / 4e0) / 12e0), 5) AS t,
    round(CASE WHEN z <= 0 THEN 1e0 WHEN z >= 1 THEN 0e0 ELSE 1e0 - z * z * (6e0 - 8e0 * z + 3e0 * z * z) END, 5) AS beta FROM g"""
)
def survival_special(spark, sf_dir):
    """Shapes whose survival functions are elementary."""
    z = standardised(spark, sf_dir)
    cases = {"gamma": (2.0, 0.0, 1.0), "t": (4.0, 0.0, 1.0), "beta": (2.0, 3.0, 0.0, 1.0)}
    return z.select("event_id", *[F.round(distributions.survival(F.col("z"), f, p), 5).alias(f) for f, p in cases.items()])


# Probability of detection

POD_SQL = f"WITH {TRAIN_SQL}, {SIGMA_SQL}, z AS (SELECT grid_id, sg.a, intercept + slope * sg.a AS m, ({THRESHOLD}e0 - intercept - slope * sg.a) / sigma AS z FROM sg, l)"


@query(POD_SQL + f" SELECT grid_id, {THRESHOLD}e0 AS threshold, round(1e0 - {distributions.norm_cdf_sql('z')}, 5) AS pod, round(m, 1) AS mean_response FROM z")
def pod_curve_1d(spark, sf_dir):
    m, t = train(spark, sf_dir)
    out = integrate.compute_multi_dim_pod(integrate.poi_grid(t, ["a"]), {}, m, t, BANDWIDTH, ("norm", (0.0, 1.0)), THRESHOLD)
    return out.select("grid_id", "threshold", F.round("pod", 5).alias("pod"), F.round("mean_response", 1).alias("mean_response"))


SPECTRUM_SQL = f"""WITH {TRAIN_SQL}, {SIGMA_SQL}, b AS (SELECT min(signal) AS lo, max(signal) AS hi FROM s),
    th AS (SELECT i, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99e0) END AS th FROM b, (SELECT range AS i FROM range(100))),
    z AS (SELECT grid_id, th, (th - intercept - slope * sg.a) / sigma AS z FROM sg, l, th)"""


def spectrum(spark, sf_dir):
    m, t = train(spark, sf_dir)
    return integrate.threshold_spectrum(integrate.poi_grid(t, ["a"]), {}, m, t, "signal", BANDWIDTH, ("norm", (0.0, 1.0)))


@query(SPECTRUM_SQL + f" SELECT grid_id, round(th, 1) AS threshold, round(1e0 - {distributions.norm_cdf_sql('z')}, 5) AS pod FROM z")
def threshold_spectrum(spark, sf_dir):
    return spectrum(spark, sf_dir).select("grid_id", F.round("threshold", 1).alias("threshold"), F.round("pod", 5).alias("pod"))


@query(SPECTRUM_SQL + f" SELECT grid_id, round(th, 1) AS threshold, round(1e0 - {distributions.norm_cdf_sql('z')}, 5) AS pod FROM z WHERE grid_id IN (10, 30, 50, 70, 90)")
def pod_vs_threshold(spark, sf_dir):
    return integrate.pod_vs_threshold(spectrum(spark, sf_dir)).select("grid_id", F.round("threshold", 1).alias("threshold"), F.round("pod", 5).alias("pod"))


@query(
    SPECTRUM_SQL
    + f", q AS (SELECT grid_id, th, 1e0 - {distributions.norm_cdf_sql('z')} AS pod FROM z), u AS (SELECT grid_id, th AS t0, pod AS p0, lead(th) OVER (PARTITION BY grid_id ORDER BY th) AS t1, lead(pod) OVER (PARTITION BY grid_id ORDER BY th) AS p1 FROM q) SELECT grid_id, round(p0 + (p1 - p0) * ({THRESHOLD}e0 - t0) / (t1 - t0), 5) AS pod FROM u WHERE t0 <= {THRESHOLD}e0 AND t1 > {THRESHOLD}e0"
)
def spectrum_lookup(spark, sf_dir):
    return rounded(integrate.spectrum_lookup(spectrum(spark, sf_dir), THRESHOLD).select("grid_id", "pod"), 5)


#: Terms of the quadratic in two standardised inputs, in the model's order.
QUADRATIC = ("x", "y", "x * x", "x * y", "y * y")


def quadratic_sql() -> str:
    """CTEs: s, the study; q, one row with the quadratic ridge model; t, the residuals.

    The normal equations of the standardised terms are solved by elimination, one CTE for each pivot.
    """
    k = range(5)
    terms = ", ".join(f"{e} AS t{i}" for i, e in enumerate(QUADRATIC))
    cells = [f"CASE WHEN {i} = {j} THEN 1e0 + 0.1e0 / count(*) ELSE corr(t{i}, t{j}) END AS m{i}{j}" for i in k for j in k]
    sums = ", ".join([*cells, *[f"covar_pop(t{i}, signal) / stddev_pop(t{i}) AS m{i}5" for i in k], *[f"avg(t{i}) AS u{i}, stddev_pop(t{i}) AS d{i}" for i in k], "avg(signal) AS ym", "min(am) AS am, min(asd) AS asd, min(dm) AS dm, min(dsd) AS dsd"])
    ctes = [
        f"s AS ({PART_SQL})",
        "c AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(disc) AS dm, stddev_pop(disc) AS dsd FROM s)",
        "z AS (SELECT id, a, disc, signal, (a - am) / asd AS x, (disc - dm) / dsd AS y, am, asd, dm, dsd FROM s, c)",
        f"f AS (SELECT *, {terms} FROM z)",
        f"e0 AS (SELECT {sums} FROM f)",
    ]
    ctes += elimination_sql(5)
    const = " - ".join(["ym", *[f"m{i}5 / d{i} * u{i}" for i in k]])
    ctes.append(f"q AS (SELECT am, asd, dm, dsd, {const} AS b, {', '.join(f'm{i}5 / d{i} AS b{i}' for i in k)} FROM e5)")
    ctes.append(f"t AS (SELECT s.a, s.disc, s.signal - {mean_sql('s.a', 's.disc')} AS residual FROM s, q)")
    return ", ".join(ctes)


def mean_sql(a: str, disc: str) -> str:
    x, y = f"(({a} - am) / asd)", f"(({disc} - dm) / dsd)"
    return "(b + " + " + ".join(f"b{i} * " + e.replace("x", "X").replace("y", "Y").replace("X", x).replace("Y", y) for i, e in enumerate(QUADRATIC)) + ")"


KERNEL_SQL = f"exp(-((p.a - t.a) * (p.a - t.a) + (p.disc - t.disc) * (p.disc - t.disc)) / {2 * BANDWIDTH * BANDWIDTH}e0)"
NOISY_SQL = f"""k AS (SELECT p.point, p.grid_id, p.a, p.disc, sum({KERNEL_SQL}) AS w, sum({KERNEL_SQL} * residual * residual) AS v FROM p, t GROUP BY p.point, p.grid_id, p.a, p.disc),
    n AS (SELECT grid_id, {mean_sql('a', 'disc')} AS m, sqrt(v / CASE WHEN w <= 1e-12 THEN 1e-10 ELSE w END) AS sigma FROM k, q),
    o AS (SELECT grid_id, m, ({THRESHOLD}e0 - m) / sigma AS z FROM n)"""


def line_sql(i: str, lo: str, hi: str, n: int) -> str:
    return f"CASE WHEN {i} = {n - 1} THEN {hi} ELSE {lo} + {i} * (({hi} - {lo}) / {n - 1}e0) END"


RANGE_SQL = "r AS (SELECT min(a) AS a0, max(a) AS a1, min(disc) AS d0, max(disc) AS d1 FROM s)"
MESH_SQL = f"p AS (SELECT i AS point, i AS grid_id, {line_sql('(i // 30)', 'a0', 'a1', 30)} AS a, {line_sql('(i % 30)', 'd0', 'd1', 30)} AS disc FROM r, (SELECT range AS i FROM range(900)))"


def unit_sql(seed: int, n: int, dims: int) -> str:
    """(id, u0, u1, ...) of a Latin hypercube."""
    each = [f"(row_number() OVER (ORDER BY {draws.bits_sql(repr(str(seed)), repr(str(j)), 'id')}, id) - 1 + {draws.uniform_sql(repr(str(seed)), repr(f'jitter{j}'), 'id')}) / {n}e0 AS u{j}" for j in range(dims)]
    return f"SELECT id, {', '.join(each)} FROM (SELECT range AS id FROM range({n}))"


MC_SQL = f"p AS (SELECT i * {integrate.SAMPLES} + h.id AS point, i AS grid_id, {line_sql('i', 'a0', 'a1', 100)} AS a, d0 + (d1 - d0) * u0 AS disc FROM r, (SELECT range AS i FROM range(100)), ({unit_sql(42, integrate.SAMPLES, 1)}) h)"


def two_inputs(spark, sf_dir):
    s = tables.part_study(spark, sf_dir)
    m = polynomial.fit_polynomials(s, ["a", "disc"], "signal", (2,), row_id="id").models["Polynomial", 2]
    return s, m, variance.add_residuals(s, m, "signal")


def shown(pod: DataFrame) -> DataFrame:
    return pod.select("grid_id", "threshold", F.round("pod", 5).alias("pod"), F.round("mean_response", 1).alias("mean_response"))


@query(f"WITH {quadratic_sql()}, {RANGE_SQL}, {MESH_SQL}, {NOISY_SQL} SELECT grid_id, {THRESHOLD}e0 AS threshold, round(1e0 - {distributions.norm_cdf_sql('z')}, 5) AS pod, round(m, 1) AS mean_response FROM o")
def pod_surface_2d(spark, sf_dir):
    s, m, t = two_inputs(spark, sf_dir)
    return shown(integrate.compute_multi_dim_pod(integrate.poi_grid(s, ["a", "disc"]), {}, m, t, BANDWIDTH, ("norm", (0.0, 1.0)), THRESHOLD))


@query(f"WITH {quadratic_sql()}, {RANGE_SQL}, {MC_SQL}, {NOISY_SQL} SELECT grid_id, {THRESHOLD}e0 AS threshold, round(avg(1e0 - {distributions.norm_cdf_sql('z')}), 5) AS pod, round(avg(m), 1) AS mean_response FROM o GROUP BY grid_id")
def pod_mc_marginal(spark, sf_dir):
    s, m, t = two_inputs(spark, sf_dir)
    return shown(integrate.compute_multi_dim_pod(integrate.poi_grid(s, ["a"]), adaptive.input_ranges(s, ["disc"]), m, t, BANDWIDTH, ("norm", (0.0, 1.0)), [THRESHOLD]))


@query()
def poly_bootstrap_ci(spark, sf_dir):
    s = tables.part_study(spark, sf_dir)
    return bootstrap.bootstrap_pod_ci(s, ["a"], "signal", integrate.poi_grid(s, ["a"]), ["a"], {}, ("Polynomial", 1), BANDWIDTH, "norm", THRESHOLD, n_boot=1000, levels=reliability.LEVELS)


SOBOL_SQL = f"""u AS (SELECT id, {", ".join(f"{sequences.sobol_sql('id', j, sobol.SAMPLES.bit_length() - 1)} AS u{j}" for j in range(4))} FROM (SELECT range AS id FROM range({sobol.SAMPLES}))),
    h AS (SELECT a0 + u0 * (a1 - a0) AS aa, a0 + u2 * (a1 - a0) AS ab, d0 + u1 * (d1 - d0) AS da, d0 + u3 * (d1 - d0) AS db FROM u, r),
    v AS (SELECT {mean_sql('aa', 'da')} AS f, {mean_sql('ab', 'da')} AS fa, {mean_sql('aa', 'db')} AS fd FROM h, q),
    w AS (SELECT var_pop(f) AS var, avg((f - fa) * (f - fa)) / 2 AS ea, avg((f - fd) * (f - fd)) / 2 AS ed FROM v)"""


@query(f"WITH {quadratic_sql()}, {RANGE_SQL}, {SOBOL_SQL} SELECT 'a' AS variable, round(least(greatest(ea / var, 0e0), 1e0), 6) AS st FROM w UNION ALL SELECT 'disc', round(least(greatest(ed / var, 0e0), 1e0), 6) FROM w")
def sobol_total(spark, sf_dir):
    s, m, _ = two_inputs(spark, sf_dir)
    return rounded(sobol.total_order(spark, m, adaptive.input_ranges(s, ["a", "disc"])), 6)


def millions(spark, sf_dir) -> DataFrame:
    """The kernel's constant is bounded, so the signal is in millions."""
    return tables.supplier_study(spark, sf_dir).withColumn("signal", F.col("signal") / 1e6)


@query()
def kriging_fit(spark, sf_dir):
    k = kriging.fit_kriging(millions(spark, sf_dir), ["a"], "signal")
    rows = [(k[0].kernel, k[1], k[0].gamma)] if k else []
    return spark.createDataFrame(rows, "kernel string, cv_mse double, gamma double")


@query()
def kriging_loo(spark, sf_dir):
    k = kriging.fit_kriging(millions(spark, sf_dir), ["a"], "signal")
    return exports.kriging_diagnostics(k[0], spark) if k else spark.createDataFrame([], "row long, e double, scaled double")


@query()
def study_pod(spark, sf_dir):
    st = SimulationStudy(spark)
    st.add_data(tables.part_study(spark, sf_dir).drop("id"), "signal", ["a", "disc"])
    return st.pod("a", THRESHOLD, slice_values={"disc": 0.05}, n_boot=0, model_override="polynomial", force_degree=1).curve


# Designs and active learning

LHS_SQL = "WITH i AS (SELECT range AS id FROM range(200)), " + ", ".join(f"r{j} AS (SELECT id, row_number() OVER (ORDER BY {draws.bits_sql(repr(str(0)), repr(str(j)), 'id')}, id) - 1 AS k, {draws.uniform_sql(repr(str(0)), repr(f'jitter{j}'), 'id')} AS w FROM i)" for j in range(2))


@query(LHS_SQL + f", s AS ({PART_SQL}), {RANGE_SQL} SELECT r0.id, round(a0 + (a1 - a0) * ((r0.k + r0.w) / 200e0), 4) AS a, round(d0 + (d1 - d0) * ((r1.k + r1.w) / 200e0), 6) AS disc FROM r0 JOIN r1 ON r0.id = r1.id, r")
def lhs_design(spark, sf_dir):
    """A design over the ranges of a table."""
    ranges = adaptive.input_ranges(tables.part_study(spark, sf_dir), ["a", "disc"])
    out = design.generate_lhs(spark, 200, ranges, reorder=False)
    return out.select("id", F.round("a", 4).alias("a"), F.round("disc", 6).alias("disc"))


SUPPLIER_SQL = "SELECT l_suppkey AS id, sum(l_quantity) AS a, avg(l_discount) AS disc FROM lineitem GROUP BY l_suppkey"
#: A step of the recursion takes the first of the farthest rows and lowers all distances.
MAXMIN_SQL = f"""WITH RECURSIVE s AS ({SUPPLIER_SQL}), m AS (SELECT min(a) AS a0, max(a) - min(a) AS aw, min(disc) AS d0, max(disc) - min(disc) AS dw FROM s),
    p AS (SELECT list(id ORDER BY id) AS ids, list((a - a0) / aw ORDER BY id) AS x, list((disc - d0) / dw ORDER BY id) AS y FROM s, m),
    w AS (SELECT 0 AS place, CAST(1 AS BIGINT) AS k, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 THEN -1e0 ELSE (x[i] - x[1]) * (x[i] - x[1]) + (y[i] - y[1]) * (y[i] - y[1]) END) AS near FROM p
          UNION ALL SELECT place + 1, k, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = k THEN -1e0 ELSE least(near[i], (x[i] - x[k]) * (x[i] - x[k]) + (y[i] - y[k]) * (y[i] - y[k])) END)
          FROM (SELECT place, near, CAST(list_position(near, list_max(near)) AS BIGINT) AS k FROM w), p WHERE place + 1 < len(ids))
    SELECT ids[k] AS id, CAST(place AS BIGINT) AS place FROM w, p"""


@query(MAXMIN_SQL)
def maxmin_reorder(spark, sf_dir):
    """The suppliers as a design in max-min order."""
    return design.max_min_order(tables.supplier_study(spark, sf_dir), ["a", "disc"], "id")


YARD_SQL = """WITH c AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
    b AS (SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer WHERE c_acctbal < 0),
    m AS (SELECT min(x) AS x0, max(x) - min(x) AS xw, min(y) AS y0, max(y) - min(y) AS yw FROM (SELECT x, y FROM c UNION ALL SELECT x, y FROM b)),
    d AS (SELECT c.id, min(sqrt(pow((c.x - b.x) / xw, 2) + pow((c.y - b.y) / yw, 2))) AS d FROM c, b, m GROUP BY c.id)
    SELECT c.id, round(c.x, 4) AS x, y FROM c JOIN d ON c.id = d.id WHERE d > 0.05"""


@query(YARD_SQL)
def graveyard_filter(spark, sf_dir):
    c = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    b = tables.table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return rounded(adaptive.graveyard_filter(c, b, ["x", "y"]))


@query("SELECT c_custkey AS id, c_acctbal AS spread FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10")
def uncertainty_topn(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("spread"))
    return adaptive.top_uncertain(c, 10)


@query(
    gap_sql(PART_SQL, ["a"])
    + f", w AS (SELECT x, nxt, d0, d1 FROM r, (SELECT min(disc) AS d0, max(disc) AS d1 FROM s) WHERE k = 1), u AS ({unit_sql(0, 100, 2)}) SELECT round(x + (nxt - x) * u0, 6) AS a, round(d0 + (d1 - d0) * u1, 6) AS disc FROM u, w ORDER BY {draws.bits_sql(repr(str(0)), repr('pick'), 'id')}, id LIMIT 10"
)
def gap_fill(spark, sf_dir):
    return rounded(adaptive.fill_gaps(tables.part_study(spark, sf_dir), "a", ["a", "disc"], 10), 6)


@query()
def uncertainty_sample(spark, sf_dir):
    return adaptive.sample_uncertainty(tables.part_study(spark, sf_dir), ["a", "disc"], "signal", 10)


@query()
def targeted_samples(spark, sf_dir):
    s = tables.part_study(spark, sf_dir)
    out = adaptive.generate_targeted_samples(s, ["a", "disc"], "signal", 5, max_gap_ratio=0.001)
    return out if out is not None else s.select("a", "disc", F.lit("").alias("Refinement_Reason")).filter(F.lit(False))


SOLVED_SQL = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 2e0 * p_size + 1 END AS signal FROM part"


@query(f"SELECT * FROM ({SOLVED_SQL}) WHERE signal IS NOT NULL")
def solver_python(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"))
    out = PythonExecutor(lambda row: None if row["size"] % 7 == 0 else 2 * row["size"] + 1, "signal").run(p)
    return adaptive.split_results(out, ["id", "size"], "signal")[0]


@query(f"SELECT id, size FROM ({SOLVED_SQL}) WHERE signal IS NULL")
def adaptive_split(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"))
    out = p.withColumn("signal", F.when(F.col("size") % 7 != 0, 2 * F.col("size") + 1))
    return adaptive.split_results(out, ["id", "size"], "signal")[1]


@query()
def adaptive_search(spark, sf_dir):
    """The search loop resumed from a table: a gap in its range is refined twice by the solver."""
    s = tables.part_study(spark, sf_dir).select("a", (3.0 * F.col("a") + 1.0).alias("y"))
    return adaptive.run_adaptive_search(spark, PythonExecutor(lambda r: 3.0 * r["a"] + 1.0, "y"), adaptive.input_ranges(s, ["a"]), ["a"], "y", existing_data=s, n_step=10, max_iter=2, max_gap_ratio=0.001)


# The study and its executors

PAIRS_SQL = "SELECT CAST(s_suppkey AS DOUBLE) AS key, s_acctbal AS balance, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier UNION ALL SELECT CAST(c_custkey AS DOUBLE), c_acctbal, CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_acctbal > 0"


@query(PAIRS_SQL)
def study_append(spark, sf_dir):
    """Suppliers, then customers with other columns and in another order, where a negative balance is text."""
    first = tables.table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), "s_name", F.col("s_nationkey").alias("nation"))
    later = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), "c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("none").alias("balance"))
    st = SimulationStudy(spark)
    st.add_data(first, "nation", ["key", "balance"])
    st.data = st.data.withColumn("balance", F.col("balance").cast("string"))
    st.add_data(later)
    return st._validate().select(*[F.col(c).cast("double").alias(c) for c in ("key", "balance", "nation")])


@query(f"WITH s AS ({PART_SQL}) SELECT 'disc' AS input, round(median(disc), 6) AS value FROM s UNION ALL SELECT 'tax', round(median(tax), 6) FROM s")
def study_slices(spark, sf_dir):
    """Inputs that are neither of interest nor nuisances, at their medians."""
    st = SimulationStudy(spark)
    st.add_data(tables.part_study(spark, sf_dir).drop("id"), "signal", list(NAMES))
    _, _, slices = st._bind("a", "n", None)
    return spark.createDataFrame([(c, round(v, 6)) for c, v in slices.items()], "input string, value double")


@query(f"SELECT id, a AS Part_Length, signal AS Signal_dB FROM ({PART_SQL})")
def csv_files(spark, sf_dir):
    """A study written as CSV and read again, with cleaned headers."""
    path = checkpoint.new_folder(spark, "csv")
    s = tables.part_study(spark, sf_dir).select("id", F.col("a").alias(" Part Length "), F.col("signal").alias("Signal (dB)"))
    csv.write_csv(s, path)
    return csv.read_csv(spark, path).select(F.col("id").cast("long").alias("id"), F.col("Part_Length").cast("double").alias("Part_Length"), F.col("Signal_dB").cast("double").alias("Signal_dB"))


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_size % 7 <> 0 THEN 3e0 * p_size - 1 END AS signal FROM part")
def solver_cli(spark, sf_dir):
    """An external command that leaves failed runs empty and gives the outcome only, so inputs are stitched on."""
    script = "import csv, sys; v = [float(r['size']) for r in csv.DictReader(open(sys.argv[1]))]; open(sys.argv[2], 'w').write(chr(10).join(['signal', *('nan' if x % 7 == 0 else repr(3 * x - 1) for x in v)]))"
    p = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"))
    return CLIExecutor(f'{sys.executable} -c "{script}" {{input}} {{output}}', outcome_col="signal").run(p)


@query(
    gap_sql(PART_SQL, ["a"])
    + f""", w AS (SELECT x, nxt, d0, d1, a0, a1 FROM r, (SELECT min(disc) AS d0, max(disc) AS d1, min(a) AS a0, max(a) AS a1 FROM s) WHERE k = 1), u AS ({unit_sql(0, 1000, 2)}),
    c AS (SELECT id, x + (nxt - x) * u0 AS a, d0 + (d1 - d0) * u1 AS disc FROM u, w), f AS (SELECT x + (nxt - x) / 2 AS a, disc FROM s, w WHERE disc > 0.05),
    m AS (SELECT min(a) AS p0, max(a) - min(a) AS pw, min(disc) AS q0, max(disc) - min(disc) AS qw FROM (SELECT a, disc FROM c UNION ALL SELECT a, disc FROM f)),
    d AS (SELECT c.id, min(sqrt(pow((c.a - f.a) / pw, 2) + pow((c.disc - f.disc) / qw, 2))) AS d FROM c, f, m GROUP BY c.id)
    SELECT round(c.a, 6) AS a, round(c.disc, 6) AS disc FROM c JOIN d ON c.id = d.id WHERE d > 0.05 ORDER BY {draws.bits_sql(repr(str(0)), repr('pick'), 'c.id')}, c.id LIMIT 10"""
)
def gap_fill_graveyard(spark, sf_dir):
    """New points in the largest gap, away from failed ones in its middle."""
    s = tables.part_study(spark, sf_dir)
    gap = coverage.gaps(s, ["a"]).select((F.col("gap_start") + (F.col("gap_end") - F.col("gap_start")) / 2).alias("middle"))  # one row
    failed = s.filter("disc > 0.05").crossJoin(F.broadcast(gap)).select(F.col("middle").alias("a"), "disc")
    return rounded(adaptive.fill_gaps(s, "a", ["a", "disc"], 10, failed), 6)


@query("WITH w AS (SELECT c_nationkey AS probe, stddev_pop(c_acctbal) / (abs(avg(c_acctbal)) + 1e-6) AS w FROM customer GROUP BY c_nationkey) SELECT round(avg(w), 6) AS mean, round(max(w), 6) AS largest FROM w")
def relative_width(spark, sf_dir):
    t = tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("probe"), F.col("c_acctbal").alias("prediction"))
    return spark.createDataFrame([tuple(round(v, 6) for v in sufficiency.relative_width(t))], "mean double, largest double")


@query(f"SELECT arg_min(degree, log_mse) AS degree FROM ({ridge_cv_sql((1, 2, 3))})")
def selected_degree(spark, sf_dir):
    """The degree with the least cross-validated error."""
    return spark.createDataFrame([(part_fits(spark, sf_dir).winner[1],)], "degree int")


@query(f"WITH s AS ({PART_SQL}), r AS (SELECT {RIDGE_SQL} FROM s), l AS (SELECT {line_of('r')} FROM r) SELECT format('signal = {{:.4g}} + {{:.4g}} \\cdot a', intercept, slope) AS equation FROM l")
def latex_equation(spark, sf_dir):
    m = part_fits(spark, sf_dir, (1,)).models["Polynomial", 1]
    return spark.createDataFrame([(polynomial.equation(m, "signal", raw=True),)], "equation string")


UNIT_SQL = f"SELECT c_custkey AS id, {draws.uniform_sql(repr('quantile'), 'c_custkey')} AS u FROM customer"
#: Quantiles of standard families by their closed forms.
QUANTILES = {"logistic": "ln(u) - ln(1 - u)", "gumbel_r": "-ln(-ln(u))", "expon": "-ln(1 - u)", "weibull_min": "pow(-ln(1 - u), 1 / 1.5e0)", "uniform": "u", "laplace": "CASE WHEN u < 0.5 THEN ln(2 * u) ELSE -ln(2 * (1 - u)) END", "gumbel_l": "ln(-ln(1 - u))"}


@query(f"SELECT id, {', '.join(f'round({q}, 6) AS {f}' for f, q in QUANTILES.items())} FROM ({UNIT_SQL})")
def quantile_functions(spark, sf_dir):
    """Inverse distribution functions at a draw for each row."""
    u = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), draws.uniform(F.lit("quantile"), F.col("c_custkey")).alias("u"))
    return u.select("id", *[F.round(distributions.ppf_column(F.col("u"), f, (1.5, 0.0, 1.0) if f == "weibull_min" else (0.0, 1.0)), 6).alias(f) for f in QUANTILES])


# Presentation

HIST_SQL = "WITH l AS (SELECT min(value) AS lo, (max(value) - min(value)) / 25 AS w, count(value) AS total FROM events), b AS (SELECT CAST(least(floor((value - lo) / w), 24) AS INTEGER) AS bin FROM events, l) SELECT bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, count(*) AS n, round(count(*) / total / w, 8) AS density FROM b, l GROUP BY bin, lo, w, total"


@query(HIST_SQL)
def histogram(spark, sf_dir):
    h = exports.histogram(tables.table(spark, sf_dir, "events"), "value", 25)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", F.round("density", 8).alias("density"))


@query(
    "WITH h AS (SELECT stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), g AS (SELECT i AS grid_id, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99e0) END AS x FROM h, (SELECT range AS i FROM range(100))) SELECT grid_id, round(x, 4) AS x, round(sum(exp(-pow((x - c_acctbal) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 9) AS density FROM g, customer, h GROUP BY grid_id, x, n, h"
)
def density(spark, sf_dir):
    d = exports.density(tables.table(spark, sf_dir, "customer"), "c_acctbal")
    return d.select("grid_id", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


@query(f"WITH {TRAIN_SQL}, {SIGMA_SQL}, b AS (SELECT grid_id, sg.a, intercept + slope * sg.a AS m, sigma FROM sg, l) SELECT grid_id, round(a, 4) AS a, round(m, 1) AS mean, round(sigma, 1) AS sigma, round(m - 2 * sigma, 1) AS lower, round(m + 2 * sigma, 1) AS upper FROM b")
def signal_model(spark, sf_dir):
    m, t = train(spark, sf_dir)
    out = exports.signal_model(t, m, "a", {}, BANDWIDTH, t)
    return out.select("grid_id", F.round("a", 4).alias("a"), *[F.round(c, 1).alias(c) for c in ("mean", "sigma", "lower", "upper")])


@query(f"WITH s AS ({ORDER_SQL}), {fit_sql('s')}, g AS ({LINE_SQL}) SELECT grid_id, round(a, 6) AS a, round(intercept + slope * a, 2) AS mean, round(intercept + slope * a - 2 * tau, 2) AS lower, round(intercept + slope * a + 2 * tau, 2) AS upper FROM g, f")
def linear_signal_model(spark, sf_dir):
    s = tables.order_study(spark, sf_dir)
    out = exports.linear_signal_model(s, "a", linear.fit_linear_a_hat_model(s, "a", "signal"))
    return out.select("grid_id", F.round("a", 6).alias("a"), *[F.round(c, 2).alias(c) for c in ("mean", "lower", "upper")])


def panel_sql(name: str, bins: int) -> str:
    return f"""SELECT '{name}' AS variable, bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, count(*) AS n FROM
        (SELECT CAST(least(floor(({name} - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w FROM s, (SELECT min({name}) AS lo, (max({name}) - min({name})) / {bins} AS w FROM s)) GROUP BY bin, lo, w"""


@query(f"WITH s AS ({PART_SQL}) " + " UNION ALL ".join(panel_sql(c, exports.HISTOGRAM_BINS["coverage"]) for c in ("a", "signal")))
def coverage_panels(spark, sf_dir):
    """The histograms of the coverage view."""
    h = exports.coverage_panels(tables.part_study(spark, sf_dir), ["a", "signal"])
    return h.select("variable", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query(f"WITH {TRAIN_SQL} SELECT round(signal, 2) AS actual, round(signal - residual, 1) AS predicted FROM t")
def fit_diagnostics(spark, sf_dir):
    """Actual against predicted signals of the linear ridge."""
    m, t = train(spark, sf_dir)
    return exports.actual_vs_predicted(t, m, "signal").select(F.round("actual", 2).alias("actual"), F.round("predicted", 1).alias("predicted"))


@query(f"WITH s AS ({PART_SQL}), r AS (SELECT 'a' AS variable, min(a) AS lo, median(a) AS mid, max(a) AS hi FROM s UNION ALL SELECT 'n', min(n), median(n), max(n) FROM s) SELECT variable, lo AS min, mid AS median, hi AS max, round((hi - lo) / 100, 6) AS step, CAST(greatest(0, -floor(log10((hi - lo) / 100))) AS BIGINT) AS decimals FROM r")
def sliders(spark, sf_dir):
    """Limits, steps and decimals of the inputs' sliders."""
    s = tables.part_study(spark, sf_dir)
    rows = [(c, float(x["min"]), float(x["median"]), float(x["max"]), round(x["step"], 6), x["decimals"]) for c in ("a", "n") for x in [exports.slider(s, c)]]
    return spark.createDataFrame(rows, "variable string, min double, median double, max double, step double, decimals long")


@query("SELECT round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(stddev_samp(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END), 6) AS log_std, round(exp(avg(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END)), 4) AS log_scale FROM customer")
def nuisance_parameters(spark, sf_dir):
    p = errors.nuisance_parameters(tables.table(spark, sf_dir, "customer"), "c_acctbal")
    row = (*p["Normal"][1], p["Lognormal"][1][0], p["Lognormal"][1][2])
    return spark.createDataFrame([tuple(round(float(v), d) for v, d in zip(row, (4, 4, 6, 4)))], "mean double, std double, log_std double, log_scale double")


@query(
    "WITH h AS (SELECT DISTINCT p_brand AS raw, p_type FROM part), b AS (SELECT raw, p_type, regexp_replace(regexp_replace(trim(raw), '\\s', '_', 'g'), '[^A-Za-z0-9_]', '', 'g') AS base FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY raw, p_type) - 1 AS k FROM b) SELECT raw, p_type, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS name FROM k"
)
def clean_header_names(spark, sf_dir):
    """Brands as headers of a wide table that has one for each type."""
    h = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("raw"), "p_type").distinct()
    return text.cleaned(h, "raw", "raw", "p_type")
