"""Header cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_headers(names: Sequence[str]) -> list[str]:
    """Strips, turns white space into '_', drops other characters, and numbers repeats from 1."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"\s", "_", str(name).strip()))
        name, k = base, 0
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def cleaned(df: DataFrame, raw: str, *order: str, name: str = "name") -> DataFrame:
    """The rows of a column of headers with their clean names; repeats of a clean name are numbered in the given order.

    For long lists, natively; a name that is cleaned to another's numbered one is not told from it.
    """
    base = F.regexp_replace(F.regexp_replace(F.trim(F.col(raw)), r"\s", "_"), "[^A-Za-z0-9_]", "")
    place = F.row_number().over(Window.partitionBy("__base").orderBy(*order)) - 1
    out = df.withColumn("__base", base).withColumn("__k", place)
    return out.withColumn(name, F.when(F.col("__k") == 0, F.col("__base")).otherwise(F.concat_ws("_", "__base", "__k"))).drop("__base", "__k")
