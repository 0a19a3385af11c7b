"""Column functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def rotate(x: Column, s: Column) -> Column:
    """x[(t - s) mod n] at place t: the last s elements come first."""
    n = F.size(x)
    k = F.pmod(s, n)
    return F.concat(F.slice(x, n - k + 1, k), F.slice(x, F.lit(1), n - k))


def clean_number(c: Column) -> Column:
    """Null and NaN become 0, infinities the largest 32-bit floats."""
    top = 3.4028234663852886e38
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d), 0.0).when(d == float("inf"), top).when(d == float("-inf"), -top).otherwise(d)


def estimable(c: Column) -> Column:
    """NaN is not estimable: null."""
    return F.when(~F.isnan(c), c)
