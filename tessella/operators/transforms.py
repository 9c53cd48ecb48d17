"""Block strategies: transforms of several sizes, large blocks as interleaved small ones, and the choice among them.

A block is a row with an array of values in row-major order; every transform multiplies by a literal basis
inside the row. A strategy is a number from 0 to 8.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.lanes import let
from tessella.operators.blocks import dct2d, dct_basis, idct2d, two_sided

#: Strategies: number -> (name, side of the transformed parts of an 8 x 8 block; 0 for none).
STRATEGIES = {0: ("dct", 8), 1: ("identity", 0), 2: ("dct2", 2), 3: ("dct4", 4), 4: ("dct16", 16), 5: ("dct32", 32), 6: ("lines", 8), 7: ("dct_flat", 8), 8: ("dct4_flat", 4)}


def valid_strategy(code: Column) -> Column:
    return code.between(0, max(STRATEGIES))


def scales(n: int) -> list[float]:
    """Length of a cosine of each frequency over its orthonormal one."""
    return [math.sqrt(1 / n) if k == 0 else math.sqrt(2 / n) * math.cos(k * math.pi / (2 * n)) for k in range(n)]


def l1_norms(n: int) -> list[float]:
    """Sum of absolute values of each orthonormal basis row, relative to the constant one."""
    rows = dct_basis(n)
    return [sum(map(abs, row)) / sum(map(abs, rows[0])) for row in rows]


def parts(block: Column, n: int, side: int) -> Column:
    """The side x side parts of an n x n block, row after row."""
    across = n // side
    order = [[(p // across * side + i // side) * n + p % across * side + i % side for i in range(side * side)] for p in range(across * across)]
    return let(block, lambda b: F.array(*[F.array(*[F.get(b, F.lit(i)) for i in part]) for part in order]))


def joined(parts_: Column, n: int, side: int) -> Column:
    """Inverse of parts."""
    across = n // side
    order = [(y // side * across + x // side, y % side * side + x % side) for y in range(n) for x in range(n)]
    return let(parts_, lambda p: F.array(*[F.get(F.get(p, F.lit(k)), F.lit(i)) for k, i in order]))


def forward(block: Column, strategy: int, n: int = 8) -> Column:
    """Coefficients of a block under a strategy whose parts fit it."""
    side = STRATEGIES[strategy][1]
    values = F.transform(block, lambda x: x.cast("double"))
    if side == 0:
        return values
    if side == n:
        return dct2d(values, n)
    return joined(F.transform(parts(values, n, side), lambda p: dct2d(p, side)), n, side)


def inverse(coefficients: Column, strategy: int, n: int = 8) -> Column:
    side = STRATEGIES[strategy][1]
    if side == 0:
        return coefficients
    if side == n:
        return idct2d(coefficients, n)
    return joined(F.transform(parts(coefficients, n, side), lambda p: idct2d(p, side)), n, side)


def scatter(block: Column, n: int, small: int = 8) -> Column:
    """An n x n block as (n / small)^2 blocks: coefficient (y, x) goes to block (y mod k, x mod k), place (y div k, x div k)."""
    k = n // small
    order = [[(i // small * k + b // k) * n + i % small * k + b % k for i in range(small * small)] for b in range(k * k)]
    return let(block, lambda v: F.array(*[F.array(*[F.get(v, F.lit(i)) for i in part]) for part in order]))


def gather(small_blocks: Column, n: int, small: int = 8) -> Column:
    """Inverse of scatter."""
    k = n // small
    order = [(y % k * k + x % k, y // k * small + x // k) for y in range(n) for x in range(n)]
    return let(small_blocks, lambda v: F.array(*[F.get(F.get(v, F.lit(b)), F.lit(i)) for b, i in order]))


def lowest_from_dc(dc: Column, k: int) -> Column:
    """The k x k lowest frequencies of a block of k x k small ones, from these blocks' means (their orthonormal DC): a DCT of
    the means, each frequency corrected by what a small block's mean keeps of it."""
    keep = [math.sin(f * math.pi / 2 / k) / (8 * math.sin(f * math.pi / 16 / k)) if f else 1.0 for f in range(k)]
    factors = F.array(*[F.lit(1 / (keep[y] * keep[x])) for y in range(k) for x in range(k)])
    return F.zip_with(dct2d(dc, k), factors, lambda a, b: a * b)


def dc_from_lowest(llf: Column, k: int) -> Column:
    """Inverse of lowest_from_dc."""
    keep = [math.sin(f * math.pi / 2 / k) / (8 * math.sin(f * math.pi / 16 / k)) if f else 1.0 for f in range(k)]
    factors = F.array(*[F.lit(keep[y] * keep[x]) for y in range(k) for x in range(k)])
    return idct2d(F.zip_with(llf, factors, lambda a, b: a * b), k)


def cost(coefficients: Column, step: float) -> Column:
    """Bits that quantised coefficients take, roughly: one and twice the logarithm of each that isn't 0."""
    q = F.transform(coefficients, lambda v: F.floor(F.abs(v) / step + 0.5))
    return F.aggregate(q, F.lit(0.0), lambda s, x: s + F.when(x > 0, 1 + 2 * F.log2(x + 1)).otherwise(0.0))


def best_strategy(rows: DataFrame, block: str, step: float, candidates: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """rows with the cheapest strategy of each block and its cost; the lower number wins ties."""
    priced = rows.select("*", *[cost(forward(F.col(block), s), step).alias(f"_cost{s}") for s in candidates])
    choices = F.array(*[F.struct(F.round(F.col(f"_cost{s}"), 6).alias("cost"), F.lit(s).alias("strategy")) for s in candidates])
    return priced.withColumn("_best", F.array_min(choices)).select(*rows.columns, F.col("_best.strategy").alias("strategy"), F.col("_best.cost").alias("cost"))



def rebase_matrix(n: int, small: int = 8) -> list[list[float]]:
    """Row k, column j: how much coefficient j % small of part j // small adds to coefficient k of the whole, along one side."""
    whole, part = dct_basis(n), dct_basis(small)
    return [[sum(whole[k][j // small * small + i] * part[j % small][i] for i in range(small)) for j in range(n)] for k in range(n)]


def rebase(coefficients: Column, n: int, small: int = 8) -> Column:
    """Coefficients of an n x n block from those of its small x small parts, which stand where the parts do; no pixels are formed."""
    return two_sided(coefficients, rebase_matrix(n, small), n)


def unbase(coefficients: Column, n: int, small: int = 8) -> Column:
    """Inverse of rebase: the matrix is orthonormal, so its transpose leads back."""
    m = rebase_matrix(n, small)
    return two_sided(coefficients, [[m[j][k] for j in range(n)] for k in range(n)], n)
