"""Active learning: gap filling, query by committee, the graveyard, and the search loop."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..sources.checkpoint import cut
from ..sources.csv import write_csv
from . import coverage, design, polynomial, replicates, sufficiency, variance
from .executors import CLIExecutor, Executor
from .validate import number, split

DISTANCE = 0.05
#: Axes by whose cells points meet; each asks three cells an axis.
CELL_AXES = 3
CANDIDATES, COMMITTEE, ATTEMPTS = 1000, 10, 10


def graveyard_filter(candidates: DataFrame, graveyard: DataFrame | None, inputs: Sequence[str], threshold: float = DISTANCE, key: str = "id") -> DataFrame:
    """Candidates farther than ``threshold`` from every failed point, on axes scaled over both sets.

    Failed points without numbers are left out.  Both sets may be large: points meet by cells of the
    threshold's side along up to CELL_AXES axes, and a candidate asks its own and the neighbouring
    cells.  Candidates that share a cell of the threshold's diagonal with a failed point go first,
    without being compared.
    """
    if graveyard is None:
        return candidates
    bad = graveyard.select(*[number(graveyard, c).alias(c) for c in inputs]).dropna()
    both = candidates.select(*inputs).unionByName(bad)
    lim = both.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(inputs) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if threshold < 0 or bad.isEmpty():
        return candidates
    d = len(inputs)
    scale = [(float(lim[f"lo{i}"]), float(lim[f"hi{i}"] - lim[f"lo{i}"]) or 1.0) for i in range(d)]
    b = bad.select(*[((F.col(c) - lo) / w).alias(f"__b{i}") for i, (c, (lo, w)) in enumerate(zip(inputs, scale))])
    c = candidates.select(F.col(key).alias("__k"), *[((F.col(c) - lo) / w).alias(f"__c{i}") for i, (c, (lo, w)) in enumerate(zip(inputs, scale))])
    cell = lambda side, i, size: F.floor(F.col(f"__{side}{i}") / size).cast("long")
    if threshold > 0:
        small = threshold / d**0.5 * (1 - 1e-9)
        full = b.select(*[cell("b", i, small).alias(f"__f{i}") for i in range(d)]).distinct()
        c = c.withColumns({f"__s{i}": cell("c", i, small) for i in range(d)})
        c = c.join(full, reduce(and_, [F.col(f"__s{i}") == F.col(f"__f{i}") for i in range(d)]), "left_anti").drop(*[f"__s{i}" for i in range(d)])
    wide, axes = max(threshold, 1e-6) * (1 + 1e-9), range(min(d, CELL_AXES))
    asks = c
    for i in axes:
        asks = asks.withColumn(f"__q{i}", F.explode(F.array(*[cell("c", i, wide) + s for s in (-1, 0, 1)])))
    b = b.distinct().withColumns({f"__h{i}": cell("b", i, wide) for i in axes})
    d2 = sum((F.pow(F.col(f"__c{i}") - F.col(f"__b{i}"), 2) for i in range(d)), F.lit(0.0))
    met = reduce(and_, [F.col(f"__q{i}") == F.col(f"__h{i}") for i in axes])
    near = asks.join(b, met & (F.sqrt(d2) <= threshold), "left_semi").select(F.col("__k").alias("__n")).distinct()
    far = c.select("__k").join(near, F.col("__k") == F.col("__n"), "left_anti")
    return candidates.join(far, F.col(key) == F.col("__k"), "left_semi")


def input_ranges(df: DataFrame, inputs: Sequence[str]) -> dict[str, tuple[float, float]]:
    v = df.agg(*[f(f"`{c}`").cast("double") for c in inputs for f in (F.min, F.max)]).first()
    return {c: (v[2 * i], v[2 * i + 1]) for i, c in enumerate(inputs)}


def pool(spark: SparkSession, n: int, ranges: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    u = design.unit_lhs(spark, n, len(ranges), seed)
    return u.select("id", *[design.scale(F.col(f"u{j}"), lo, hi).alias(c) for j, (c, (lo, hi)) in enumerate(ranges.items())])


def fill_gaps(df: DataFrame, target: str, inputs: Sequence[str], n: int, graveyard: DataFrame | None = None, threshold: float = DISTANCE, seed: int = 0) -> DataFrame:
    """n points whose target lies in its largest gap and whose other inputs span their ranges."""
    gap = coverage.gaps(df, [target]).first()
    ranges = input_ranges(df, inputs)
    ranges[target] = (gap["gap_start"] if gap["gap_start"] is not None else gap["lo"], gap["gap_end"] if gap["gap_end"] is not None else gap["hi"])
    size = max(10 * n, 100) * (ATTEMPTS if graveyard is not None else 1)
    found = graveyard_filter(pool(df.sparkSession, size, ranges, seed), graveyard, inputs, threshold)
    order = draws.bits(F.lit(seed), F.lit("pick"), F.col("id"))
    return found.orderBy(order, "id").limit(n).select(*inputs)


def committee_spread(candidates: DataFrame, models: Sequence[polynomial.PolynomialModel]) -> DataFrame:
    """The candidates with the population deviation of the models' predictions."""
    wide = candidates
    for i, m in enumerate(models):
        wide = variance.predict(wide, m, f"__p{i}")
    preds = [F.col(f"__p{i}") for i in range(len(models))]
    mean = sum(preds, F.lit(0.0)) / len(models)
    spread = F.sqrt(sum(((p - mean) * (p - mean) for p in preds), F.lit(0.0)) / len(models))
    return wide.withColumn("spread", spread).drop(*[f"__p{i}" for i in range(len(models))])


def top_uncertain(candidates: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n candidates of largest spread, in ascending order; of ties the largest keys."""
    return candidates.orderBy(F.desc("spread"), F.desc(key)).limit(n).orderBy("spread", key)


def sample_uncertainty(df: DataFrame, inputs: Sequence[str], outcome: str, n: int, graveyard: DataFrame | None = None, threshold: float = DISTANCE, seed: int = 0) -> DataFrame:
    """n points where a committee of resampled polynomial fits disagrees most."""
    none = df.select(*inputs).filter(F.lit(False))
    if n <= 0:
        return none
    candidates = graveyard_filter(pool(df.sparkSession, CANDIDATES, input_ranges(df, inputs), seed), graveyard, inputs, threshold)
    fits = polynomial.fit_polynomials(df, inputs, outcome, (1, 2, 3), folds=5, alpha=0.0)
    degree = fits.winner[1]
    models = replicates.fit(df, inputs, outcome, degree, COMMITTEE, alpha=0.0, seed=seed).models
    return top_uncertain(committee_spread(candidates, models), n).select(*inputs)


def generate_targeted_samples(df: DataFrame, inputs: Sequence[str], outcome: str, n_new_per_fix: int = 10, failed_data: DataFrame | None = None, distance_threshold: float = DISTANCE, seed: int = 0, **limits) -> DataFrame | None:
    """New points with a Refinement_Reason for each failed check; None where all pass or none can be made.

    Every failing coverage variable is filled once; failing fit or convergence is answered once.
    """
    report = sufficiency.sample_sufficiency(df, inputs, outcome, **limits).orderBy("ord").collect()
    parts, handled = [], set()
    for r in report:
        if r["Pass"]:
            continue
        if r["Test"] == "Input Coverage" and r["Variable"] not in handled:
            handled.add(r["Variable"])
            part = fill_gaps(df, r["Variable"], inputs, n_new_per_fix, failed_data, distance_threshold, seed + len(handled))
            parts.append(part.withColumn("Refinement_Reason", F.lit(f"Gap in {r['Variable']}")))
        elif r["Test"] in ("Model Fit (CV)", "Bootstrap Convergence") and "" not in handled:
            handled.add("")
            part = sample_uncertainty(df, inputs, outcome, n_new_per_fix, failed_data, distance_threshold, seed + len(handled))
            parts.append(part.withColumn("Refinement_Reason", F.lit("High Model Uncertainty")))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def check_output(results: DataFrame, samples: DataFrame, inputs: Sequence[str], outcome: str) -> int:
    """The number of result rows; 0 is a failed batch, and any other result must keep the contract."""
    n = results.count()
    if not n:
        return 0
    missing = [c for c in [outcome, *inputs] if c not in results.columns]
    if missing:
        raise ValueError(f"executor output lacks {missing}")
    if n != samples.count():
        raise ValueError(f"executor returned {n} rows for {samples.count()} samples")
    return n


def split_results(results: DataFrame, inputs: Sequence[str], outcome: str) -> tuple[DataFrame, DataFrame]:
    """(rows with an outcome, inputs of the rows without)."""
    good = F.col(outcome).isNotNull() & ~F.isnan(F.col(outcome).cast("double"))
    return results.filter(good), results.filter(~good).select(*inputs)


def run_adaptive_search(spark: SparkSession, executor: Executor | str, ranges, inputs: Sequence[str], outcome: str, existing_data: DataFrame | None = None, n_start: int = 20, n_step: int = 10, max_iter: int = 5, max_hours: float | None = None, output_csv: str | None = None, seed: int = 0, **limits) -> DataFrame:
    """Design, solve, diagnose and refine until all checks pass, nothing can be added, or time is up.

    Resumes from existing data.  Each round is cut to the shared checkpoint folder.
    """
    if isinstance(executor, str):
        executor = CLIExecutor(executor, outcome_col=outcome)
    began = time.time()
    columns = [*inputs, outcome]
    data, graveyard = existing_data.select(*columns) if existing_data is not None else None, None

    def attempt(samples: DataFrame) -> None:
        nonlocal data, graveyard
        samples = cut(samples.select(*inputs))
        results = executor.run(samples)
        if check_output(results, samples, inputs, outcome):
            good, failed = split_results(results, inputs, outcome)
            good = good.select(*columns)
        else:
            good, failed = None, samples
        if good is not None:
            data = cut(good if data is None else data.unionByName(good))
        graveyard = cut(failed if graveyard is None else graveyard.unionByName(failed))
        if output_csv and data is not None and not data.isEmpty():
            write_csv(data, output_csv)

    if data is None or data.isEmpty():
        data = None
        attempt(design.generate_lhs(spark, n_start, ranges, seed))
    elif output_csv:
        write_csv(data, output_csv)
    for i in range(max_iter):
        if max_hours is not None and time.time() - began > 3600 * max_hours:
            break
        if data is None:
            break
        data = cut(split(data, inputs, outcome)[0])
        if sufficiency.sample_sufficiency(data, inputs, outcome, skip_validation=True, **limits).filter("NOT Pass").isEmpty():
            break
        new = generate_targeted_samples(data, inputs, outcome, n_step, graveyard, DISTANCE, seed + 100 * (i + 1), skip_validation=True, **limits)
        if new is None or new.isEmpty():
            break
        attempt(new)
    return data if data is not None else spark.createDataFrame([], ", ".join(f"`{c}` double" for c in columns))
