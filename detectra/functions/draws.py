"""Random draws that are a function of (seed, key), alike in every engine and on every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(2**32)


def bits(*keys) -> Column:
    """32 bits of the md5 of the keys joined by ':', as a bigint."""
    text = F.concat_ws(":", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*keys) -> Column:
    """A draw in (0, 1)."""
    return (bits(*keys) + F.lit(0.5)) / F.lit(SPAN)


def index(n, *keys) -> Column:
    """A draw of 0 .. n - 1."""
    return F.pmod(bits(*keys), n if isinstance(n, Column) else F.lit(n))


def bits_sql(*keys: str) -> str:
    """The same draw as DuckDB SQL over SQL operands."""
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def uniform_sql(*keys: str) -> str:
    return f"(({bits_sql(*keys)} + 0.5e0) / 4294967296e0)"
