"""Elementary functions to a stated tolerance, as built-in expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log2(v: Column) -> Column:
    """Binary logarithm; 0 for what isn't positive."""
    return F.when(v > 0, F.log2(v)).otherwise(0.0)


def cube_root(v: Column) -> Column:
    return F.cbrt(v)


def libm_cube_root(v: Column) -> Column:
    """The C library's cube root to the last bit, in Arrow batches; Java's differs by one place in more than half of all cases."""

    @F.pandas_udf("double")
    def root(v: pd.Series) -> pd.Series:
        return pd.Series([math.cbrt(x) for x in v], dtype="float64")

    return root(v)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Horner's rule, coefficients from the constant one up."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def rational(x: Column, p: Sequence[float], q: Sequence[float]) -> Column:
    """p(x) / q(x)."""
    return polynomial(x, p) / polynomial(x, q)
