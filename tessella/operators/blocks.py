"""Blocks of coefficients: transforms by basis tables, quantisation and scan order.

A block is one row with an array of N*N values in row-major order. Transforms multiply by a basis that
is a literal of the plan, inside the row: no shuffle, no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.lanes import let

def dct_basis(n: int) -> list[list[float]]:
    """Orthonormal DCT-II: row k is the k-th frequency."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos((2 * i + 1) * k * math.pi / (2 * n)) for i in range(n)] for k in range(n)]


def basis_literal(m: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in m])


def _rows(block: Column, n: int) -> Column:
    return let(block, lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(b, i * n + 1, n)))


def transpose_block(block: Column, n: int) -> Column:
    return let(block, lambda b: F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: F.element_at(b, ((i % n) * n + F.floor(i / n) + 1).cast("int"))))


def _times(block: Column, basis: Column, n: int) -> Column:
    """Each row of the block times the basis, written as rows of the transposed result: (block basis^T)^T."""
    dot = lambda row, b: F.aggregate(F.zip_with(row, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return let(_rows(block, n), lambda rows: F.flatten(F.transform(basis, lambda b: F.transform(rows, lambda row: dot(row, b)))))


def dct2d(block: Column, n: int = 8) -> Column:
    """2-D DCT of a block, in row-major order of (vertical, horizontal) frequency."""
    basis = basis_literal(dct_basis(n))
    values = F.transform(block, lambda x: x.cast("double"))
    return _times(_times(values, basis, n), basis, n)


def idct2d(coefficients: Column, n: int = 8) -> Column:
    m = dct_basis(n)
    basis = basis_literal([[m[k][i] for k in range(n)] for i in range(n)])
    values = F.transform(coefficients, lambda x: x.cast("double"))
    return _times(_times(values, basis, n), basis, n)


def two_sided(block: Column, matrix: list[list[float]], n: int) -> Column:
    """matrix * block * its transpose, for a square matrix of numbers."""
    literal = basis_literal(matrix)
    return _times(_times(F.transform(block, lambda x: x.cast("double")), literal, n), literal, n)


def blocks_of(pixels: DataFrame, n: int = 8) -> DataFrame:
    """(image_id, c, by, bx, block) of a grid whose size is a multiple of n."""
    at = pixels.select("image_id", "c", F.floor(F.col("y") / n).cast("int").alias("by"), F.floor(F.col("x") / n).cast("int").alias("bx"), ((F.col("y") % n) * n + F.col("x") % n).alias("i"), "v")
    return at.groupBy("image_id", "c", "by", "bx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("block"))


def pixels_of(blocks: DataFrame, n: int = 8) -> DataFrame:
    cells = blocks.select("image_id", "c", "by", "bx", F.posexplode("block").alias("i", "v"))
    return cells.select("image_id", "c", (F.col("by") * n + F.floor(F.col("i") / n)).cast("int").alias("y"), (F.col("bx") * n + F.col("i") % n).cast("int").alias("x"), "v")


def zigzag(n: int = 8) -> list[int]:
    """Positions of a block in order of rising diagonal, the direction alternating."""
    cells = [(y, x) for y in range(n) for x in range(n)]
    return [y * n + x for y, x in sorted(cells, key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


def zigzag_table(spark: SparkSession, n: int = 8) -> DataFrame:
    rank = {p: r for r, p in enumerate(zigzag(n))}
    return spark.range(n * n).select(F.col("id").cast("int").alias("i"), F.element_at(F.array(*[F.lit(rank[i]) for i in range(n * n)]), (F.col("id") + 1).cast("int")).alias("zigzag"))


def coefficient_order(cells: DataFrame, table: DataFrame) -> DataFrame:
    """(c, i, place): positions by how often they are zero, in steps of 8, then in scan order."""
    zeros = cells.groupBy("c", "i").agg(F.count_if(F.col("q") == 0).alias("zeros")).join(table, "i")
    return zeros.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.floor(F.col("zeros") / 8), "zigzag")) - 1)


def dc(block: Column) -> Column:
    return F.element_at(block, 1)


def nonzero(block: Column) -> Column:
    return F.size(F.filter(block, lambda q: q != 0))


def quantise(v: Column, step: float) -> Column:
    """Nearest multiple, halves away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) / step + 0.5)).cast("int")


# Expected value of a quantised 1, less than 1 by these, and the numerator for larger ones.
ONE_BIAS = (0.05465007330715401, 0.07005449891748593, 0.049935103337343655)
BIAS_NUMERATOR = 0.145


def unbias(q: Column, channel: int) -> Column:
    """Expected value of what was quantised to q."""
    one = 1 - ONE_BIAS[channel]
    return F.when(q == 0, 0.0).when(q == 1, one).when(q == -1, -one).otherwise(q - BIAS_NUMERATOR / q)


def quant_field(field: DataFrame, value: str, scale: int = 1 << 16) -> DataFrame:
    """Global scale from median less median absolute deviation, and the field in its steps, 1 to 256."""
    from tessella.operators.stats import medians

    whole = medians(field, value, []).select(F.greatest(F.lit(1.0), F.floor(scale * (F.col("median") - F.col("mad")) / 64)).alias("global_scale"))
    step = F.floor(F.lit(float(scale)) * F.col(value) / F.col("global_scale") + 0.5)
    return field.crossJoin(F.broadcast(whole)).withColumn("q", F.greatest(F.lit(1), F.least(F.lit(256), step)).cast("int"))  # one row


def clamp_correction(original: Column, corrected: Column, interval: Column) -> Column:
    """corrected, moved back to within half an interval of the original."""
    return original + F.greatest(F.least(corrected - original, 0.5 * interval), -0.5 * interval)


def progressive_pass(i: Column, n: int = 8, corners: tuple[int, ...] = (2, 3, 8)) -> Column:
    """The pass that sends coefficient i: the first whose square corner holds it."""
    reach = F.greatest((i % n).cast("int"), F.floor(i / n).cast("int"))
    out = F.when(reach < corners[0], 0)
    for k, side in enumerate(corners[1:], 1):
        out = out.when(reach < side, k)
    return out
