"""Sobol' points: low-discrepancy numbers as bit operations on a row's number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 32
#: Degree, coefficients and first direction numbers of the published table of Joe and Kuo (2008),
#: from the second dimension on.
TABLE = (
    (1, 0, (1,)),
    (2, 1, (1, 3)),
    (3, 1, (1, 3, 1)),
    (3, 2, (1, 1, 1)),
    (4, 1, (1, 1, 3, 3)),
    (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)),
    (5, 7, (1, 1, 7, 11, 19)),
    (5, 11, (1, 1, 5, 1, 1)),
    (5, 13, (1, 1, 1, 3, 11)),
    (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)),
    (6, 13, (1, 1, 1, 15, 21, 21)),
    (6, 16, (1, 3, 1, 13, 27, 49)),
)
DIMENSIONS = 1 + len(TABLE)


def directions(dimension: int, bits: int) -> list[int]:
    """The first direction numbers of a dimension (from 0), as integers of BITS bits."""
    if dimension == 0:
        return [1 << (BITS - 1 - i) for i in range(bits)]
    degree, a, m = TABLE[dimension - 1]
    v = [x << (BITS - 1 - i) for i, x in enumerate(m)]
    for i in range(degree, bits):
        new = v[i - degree] ^ (v[i - degree] >> degree)
        for k in range(1, degree):
            if (a >> (degree - 1 - k)) & 1:
                new ^= v[i - k]
        v.append(new)
    return v[:bits]


def sobol(number: Column, dimension: int, bits: int) -> Column:
    """The coordinate in [0, 1) of the point with that number, below 2**bits, in the usual order by Gray code."""
    gray = number.bitwiseXOR(F.shiftright(number, 1))
    terms = [F.when(F.getbit(gray, F.lit(i)) == 1, F.lit(v)).otherwise(F.lit(0)).cast("long") for i, v in enumerate(directions(dimension, bits))]
    return reduce(lambda x, y: x.bitwiseXOR(y), terms) / F.lit(2.0**BITS)


def sobol_sql(number: str, dimension: int, bits: int) -> str:
    """The same for DuckDB."""
    terms = [f"CASE WHEN (xor({number}, {number} >> 1) >> {i}) & 1 = 1 THEN {v} ELSE 0 END" for i, v in enumerate(directions(dimension, bits))]
    return f"({reduce(lambda x, y: f'xor(CAST({x} AS BIGINT), {y})', terms)} / {2.0**BITS!r}e0)"
