"""The sample-sufficiency report: coverage, model fit, bootstrap convergence, collinearity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import coverage, polynomial, reliability, replicates
from .validate import correlation, quantiles, validate_simulation

REPORT = "ord long, Test string, Variable string, Metric string, Value double, Threshold string, Pass boolean"
PROBES = (0.1, 0.5, 0.9)
RESAMPLES = 100


def vif(df: DataFrame, inputs: Sequence[str]) -> dict[str, float]:
    """Variance inflation factors from the inverse correlation matrix; one aggregation.

    1 for a single input; infinite where an input is a linear function of the others.
    """
    d = len(inputs)
    if d == 1:
        return {inputs[0]: 1.0}
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    row = df.agg(*[correlation(F.col(f"`{inputs[i]}`"), F.col(f"`{inputs[j]}`")) for i, j in pairs]).first()
    R = np.eye(d)
    for (i, j), v in zip(pairs, row):
        R[i, j] = R[j, i] = 0.0 if v is None or np.isnan(v) else v
    out = {}
    for i, c in enumerate(inputs):
        rest = [j for j in range(d) if j != i]
        w = np.linalg.lstsq(R[np.ix_(rest, rest)], R[rest, i], rcond=1e-12)[0]
        r2 = float(R[i, rest] @ w)
        out[c] = float("inf") if r2 >= 1 - 1e-10 else round(1 / (1 - r2), 4)
    return out


def convergence(df: DataFrame, inputs: Sequence[str], outcome: str, n: int = RESAMPLES, degree: int = 2) -> DataFrame:
    """(replicate, probe, prediction) of quadratic fits to resamples of all rows at joint percentiles of the inputs."""
    spark = df.sparkSession
    points = np.array(list(quantiles(df, {c: F.col(f"`{c}`") for c in inputs}, PROBES).values()), float).T
    fits = replicates.fit(df, inputs, outcome, degree, n, alpha=0.0, seed=42)
    found = fits.predict(points)
    rows = pa.table({"replicate": np.repeat(np.arange(n), len(points)), "probe": np.tile(np.arange(len(points)), n), "prediction": found.T.ravel()})
    return spark.createDataFrame(rows.to_pandas(), "replicate long, probe long, prediction double")


def relative_width(predictions: DataFrame) -> tuple[float, float]:
    width = F.stddev_pop("prediction") / (F.abs(F.avg("prediction")) + 1e-6)
    r = predictions.groupBy("probe").agg(width.alias("w")).agg(F.avg("w"), F.max("w")).first()
    return float(r[0]), float(r[1])


def model_fit(df: DataFrame, inputs: Sequence[str], outcome: str, row_id: str | None = None) -> float:
    """Mean cross-validated R2 of a cubic; 10 folds for more than 50 rows, else 5."""
    k = 10 if df.limit(51).count() > 50 else 5
    fits = polynomial.fit_polynomials(df, inputs, outcome, [3], k, alpha=0.0, row_id=row_id)
    return fits.cv_r2.get(("Polynomial", 3), float("nan"))


def sample_sufficiency(df: DataFrame, inputs: Sequence[str], outcome: str, skip_validation: bool = False, max_gap_ratio: float = 0.20, min_r2_score: float = 0.50, max_avg_cv: float = 0.15, max_max_cv: float = 0.30, max_allowed_vif: float = 5.0) -> DataFrame:
    """The report, in order: coverage by input, model fit, average and largest spread, VIF by input."""
    clean = df if skip_validation else validate_simulation(df, inputs, outcome)[0]
    gaps = {r["variable"]: r for r in coverage.coverage(clean, inputs, max_gap_ratio).collect()}
    rows = [("Input Coverage", c, "Max Gap Ratio", gaps[c]["max_gap_ratio"], f"< {max_gap_ratio:.2f}", gaps[c]["sufficient"]) for c in inputs]
    r2 = model_fit(clean, inputs, outcome)
    rows.append(("Model Fit (CV)", outcome, "Mean R2 Score", round(r2, 4), f"> {min_r2_score:.2f}", r2 > min_r2_score))
    avg, top = relative_width(convergence(clean, inputs, outcome))
    rows.append(("Bootstrap Convergence", outcome, "Avg CV (Rel Std Dev)", round(avg, 4), f"< {max_avg_cv:.2f}", avg < max_avg_cv))
    rows.append(("Bootstrap Convergence", outcome, "Max CV (Rel Std Dev)", round(top, 4), f"< {max_max_cv:.2f}", top < max_max_cv))
    rows += [("Collinearity Check", c, "VIF", v, f"< {max_allowed_vif:.2f}", v <= max_allowed_vif) for c, v in vif(clean, inputs).items()]
    return df.sparkSession.createDataFrame([(i, *r[:3], float(r[3]), r[4], bool(r[5])) for i, r in enumerate(rows)], REPORT)


def convergence_trace(df: DataFrame, inputs: Sequence[str], outcome: str) -> DataFrame:
    return reliability.convergence_trace(convergence(df, inputs, outcome))
