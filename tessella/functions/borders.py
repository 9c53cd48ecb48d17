"""Border policies: the column or row that stands in for one outside a grid of n."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Policy = Callable[[Column, int], Column]


def mirror(x: Column, n: int) -> Column:
    """Reflection that repeats the border: -1 is 0, n is n - 1; any distance."""
    m = F.pmod(x, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def mirror_inner(x: Column, n: int) -> Column:
    """Reflection about the border, which is not repeated: -1 is 1, n is n - 2."""
    if n == 1:
        return F.lit(0) + 0 * x
    m = F.pmod(x, F.lit(2 * n - 2))
    return F.when(m < n, m).otherwise(2 * n - 2 - m)


def clamp(x: Column, n: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))


def drop(x: Column, n: int) -> Column:
    """What is outside has no value; weights are to be normalised over the rest."""
    return F.when((x >= 0) & (x < n), x)


POLICIES: dict[str, Policy] = {"mirror": mirror, "mirror_inner": mirror_inner, "clamp": clamp, "drop": drop}
