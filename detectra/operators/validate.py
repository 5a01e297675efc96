"""Numeric validation and summaries of a study table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as numbers; gates try_cast, which also takes suffixes such as '1d'.
NUMERIC = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"
LEAST_ROWS = 10
#: Values that one aggregation buffer may sort; beyond, quantiles are bracketed first.
EXACT_ROWS = 100_000


class ValidationError(ValueError):
    """Raised when a table cannot be studied."""


def number(df: DataFrame, name: str) -> Column:
    """A column as double; NULL where it is not a number.  NaN is no number, infinities are."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        low = F.lower(F.trim(c))
        return F.when(low.rlike(NUMERIC), F.expr(f"try_cast(trim(`{name}`) AS double)"))
    if isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
        c = c.cast("double")
        return F.when(~F.isnan(c), c)
    return F.lit(None).cast("double")


def split(df: DataFrame, inputs: Sequence[str], outcome: str) -> tuple[DataFrame, DataFrame]:
    """(clean, removed): clean rows as doubles, removed rows as they came, with all columns.  No action runs."""
    missing = [c for c in [*inputs, outcome] if c not in df.columns]
    if missing:
        raise ValidationError(f"missing columns: {missing}")
    if outcome in inputs:
        raise ValidationError(f"outcome {outcome!r} is also an input")
    required = [*inputs, outcome]
    valid = F.lit(True)
    for c in required:
        valid = valid & number(df, c).isNotNull()
    return df.filter(valid).select(*[number(df, c).alias(c) for c in required]), df.filter(~valid)


def validate_simulation(df: DataFrame, inputs: Sequence[str], outcome: str, least: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """``split``, after checking that enough clean rows are left; negative outcomes are valid."""
    if not isinstance(df, DataFrame):
        raise ValidationError("input is not a DataFrame")
    clean, removed = split(df, inputs, outcome)
    n = clean.limit(least).count()
    if n < least:
        raise ValidationError("the table is empty" if df.isEmpty() else f"only {n} valid rows; at least {least} are needed")
    return clean, removed


def ranked(rows: DataFrame, wanted: set[tuple[str, int]], sizes: dict[str, int], most: int) -> dict[tuple[str, int], float]:
    """Values at (column, rank) of the sorted non-null values of columns.

    Two pivots of a sketch lie about a wanted rank and counts say which side of them it is on, so each
    round leaves about a thousandth of the values, strictly between pivots; at most ``most`` are sorted at last.
    """
    found: dict[tuple[str, int], float] = {}
    live = {(c, r): (None, None, 0, sizes[c]) for c, r in wanted}  # open interval, values up to it, values in it

    def inside(c: str, lo: float | None, hi: float | None) -> Column:
        v = F.col(c)
        return F.when((F.lit(True) if lo is None else v > lo) & (F.lit(True) if hi is None else v < hi), v)

    while live:
        small = {k: s for k, s in live.items() if s[3] <= most}
        if small:
            last = [F.sort_array(F.collect_list(inside(c, lo, hi)))[r - below] for (c, r), (lo, hi, below, _) in small.items()]
            found |= dict(zip(small, rows.agg(*last).first()))
        live = {k: s for k, s in live.items() if k not in small}
        if not live:
            break
        shares = [(r - below) / n for (_, r), (_, _, below, n) in live.items()]
        pivots = rows.agg(*[F.percentile_approx(inside(c, lo, hi), [max(0.0, p - 0.0005), min(1.0, p + 0.0005)], 10_000) for ((c, _), (lo, hi, _, _)), p in zip(live.items(), shares)]).first()
        counts = rows.agg(*[F.struct(*[F.count(F.when(x, 1)) for x in (v < a, v == a, (v > a) & (v < b), v == b)]) for (k, s), (a, b) in zip(live.items(), pivots) for v in [inside(k[0], *s[:2])]]).first()
        state = {}
        for ((c, r), (lo, hi, below, n)), (a, b), (under, at_a, between, at_b) in zip(live.items(), pivots, counts):
            if a == b:
                at_b = 0
            steps = [below + under]
            for k in (at_a, between, at_b):
                steps.append(steps[-1] + k)
            if r < steps[0]:
                state[c, r] = (lo, a, below, under)
            elif r < steps[1]:
                found[c, r] = a
            elif r < steps[2]:
                state[c, r] = (a, b, steps[1], between)
            elif r < steps[3]:
                found[c, r] = b
            else:
                state[c, r] = (b, hi, steps[3], below + n - steps[3])
        live = state
    return found


def quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float], most: int = EXACT_ROWS) -> dict[str, list[float | None]]:
    """Exact quantiles of the columns' numbers, interpolated between neighbours, in bounded memory; None without numbers."""
    rows = df.select(*[c.cast("double").alias(f"v{i}") for i, c in enumerate(columns.values())])
    sizes = dict(zip(rows.columns, rows.agg(*[F.count(c) for c in rows.columns]).first()))
    at = {(c, p): p * (n - 1) for c, n in sizes.items() if n for p in probs}
    found = ranked(rows, {(c, r) for (c, _), x in at.items() for r in (math.floor(x), math.ceil(x))}, sizes, most)
    out = {}
    for name, c in zip(columns, rows.columns):
        places = [at.get((c, p)) for p in probs]
        out[name] = [None if x is None else found[c, int(x)] if x == int(x) else (math.ceil(x) - x) * found[c, math.floor(x)] + (x - math.floor(x)) * found[c, math.ceil(x)] for x in places]
    return out


def data_summary(df: DataFrame, name: str) -> dict[str, float | None]:
    """min, median and max of the numbers of a column; all None where there are none."""
    if name not in df.columns:
        return {"min": None, "median": None, "max": None}
    lo, mid, hi = quantiles(df, {name: number(df, name)}, (0.0, 0.5, 1.0))[name]
    return {"min": lo, "median": mid, "max": hi}


def summary_statistics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """variable, n_total, n_valid, min, median, max, mean, std (sample), one row for each column."""
    medians = quantiles(df, {c: number(df, c) for c in names}, (0.5,))
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for i, c in enumerate(names):
        v = number(df, c)
        aggs += [f(v).alias(f"{k}{i}") for k, f in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))]
        aggs.append(F.lit(medians[c][0]).cast("double").alias(f"median{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col("n_total"), F.col(f"n{i}").alias("n_valid"), *[F.col(f"{k}{i}").alias(k) for k in ("min", "median", "max", "mean", "std")]) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where a side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, correlation) of all ordered pairs; NULL where a column is constant."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = df.agg(*[correlation(F.col(f"`{names[i]}`"), F.col(f"`{names[j]}`")).alias(f"c{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("v")) for i, a in enumerate(names) for j, b in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.a", "r.b", F.when(~F.isnan("r.v"), F.col("r.v")).alias("correlation"))
