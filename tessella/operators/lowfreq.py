"""Coefficients of blocks predicted from the blocks around them, in two steps that a decoder can repeat.

The means of blocks are coded first. Every block's three next frequencies are predicted from the means of the blocks
around it, blurred at twice the blocks' resolution; what is left is quantised. These four frequencies give means of quarter
blocks, whose blurred enlargement predicts all other frequencies. Both steps look at decoded values of the step before only,
so all blocks go at once and none waits for its neighbour: a block is sent to the up to eight around it, as four numbers,
and one shuffle per step brings them together. Encoder and decoder share both steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.lanes import let
from tessella.operators.blocks import basis_literal, dct_basis, quantise
from tessella.operators.stencil import gaussian, symmetric3

KEY = ("image_id", "c", "by", "bx")
# Kernel that blurs means of half the blocks' sides, and the strength of the blur of enlarged quarters.
BLUR3 = (0.41459272584128337, 0.25489157325704559, 0.046449679523692139)
ENLARGED_SIGMA = 2.0007879236394901
#: Coefficients that the first step predicts.
LOW = (1, 8, 9)


def halves_to_low() -> list[list[float]]:
    """Row k, column h: what the mean of half h adds to frequency k of eight values, if there is nothing above frequency 1."""
    flat, first = dct_basis(8)[0][0], sum(dct_basis(8)[1][:4]) / 4
    return [[1 / (2 * flat)] * 2, [1 / (2 * first), -1 / (2 * first)]]


def low_to_halves() -> list[list[float]]:
    flat, first = dct_basis(8)[0][0], sum(dct_basis(8)[1][:4]) / 4
    return [[flat, first], [flat, -first]]


def enlarged_dct() -> list[list[float]]:
    """Row k, columns one before the block, its two halves, and one after it: frequency k of these four, each repeated
    four times and blurred, over the eight values of the block."""
    taps, basis = gaussian(4, ENLARGED_SIGMA), dct_basis(8)
    pixels = [[sum(w for d, w in enumerate(taps, -4) if (i + d) // 4 + 1 == cell) for cell in range(4)] for i in range(8)]
    return [[sum(basis[k][i] * pixels[i][cell] for i in range(8)) for cell in range(4)] for k in range(8)]


def _sided(cells: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """matrix * cells * its transpose, for a square array of cells as wide as the matrix."""
    n, literal = len(matrix[0]), basis_literal([list(row) for row in matrix])
    dot = lambda row, m: F.aggregate(F.zip_with(row, m, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def times(values: Column) -> Column:
        rows = let(values, lambda b: F.transform(F.sequence(F.lit(0), (F.size(b) / n - 1).cast("int")), lambda i: F.slice(b, i * n + 1, n)))
        return let(rows, lambda r: F.flatten(F.transform(literal, lambda m: F.transform(r, lambda row: dot(row, m)))))

    return times(times(cells))


def around(blocks: DataFrame, halves: Column, width: int, height: int) -> DataFrame:
    """blocks with `cells`: the 4 x 4 means of half-sides in and around each, row after row.

    width and height are in blocks. Outside the image the nearest cell stands; a block that is missing inside counts as zeros.
    """
    kept = F.struct(*[F.col(c) for c in blocks.columns])
    places = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    sent = blocks.select(*KEY, kept.alias("_kept"), halves.alias("_halves"), F.explode(places).alias("o"))
    own = (F.col("o.dy") == 0) & (F.col("o.dx") == 0)
    to_y, to_x = (F.col("by") + F.col("o.dy")).alias("by"), (F.col("bx") + F.col("o.dx")).alias("bx")
    nth = (4 - 3 * F.col("o.dy") - F.col("o.dx")).alias("nth")  # how the receiver sees the sender
    sent = sent.select("image_id", "c", to_y, to_x, F.struct(nth, F.col("_halves").alias("m")).alias("_m"), F.when(own, F.col("_kept")).alias("_kept"))
    sent = sent.where((F.col("by") >= 0) & (F.col("bx") >= 0) & (F.col("by") < height) & (F.col("bx") < width))
    met = sent.groupBy(*KEY).agg(F.map_from_entries(F.collect_list("_m")).alias("_m"), F.any_value("_kept", ignoreNulls=True).alias("_kept")).where("_kept is not null")

    def cell(j: int, i: int) -> Column:
        y = F.least(F.greatest(2 * F.col("by") + j, F.lit(0)), F.lit(2 * height - 1))
        x = F.least(F.greatest(2 * F.col("bx") + i, F.lit(0)), F.lit(2 * width - 1))
        sender = (F.floor(y / 2) - F.col("by") + 1) * 3 + F.floor(x / 2) - F.col("bx") + 1
        return F.coalesce(F.get(F.col("_m")[sender.cast("int")], (y % 2 * 2 + x % 2).cast("int")), F.lit(0.0))

    return met.withColumn("cells", F.array(*[cell(j, i) for j in range(-1, 3) for i in range(-1, 3)])).select("_kept.*", "cells")


def with_low(blocks: DataFrame, mean: str, width: int, height: int) -> DataFrame:
    """blocks with `low`: their first frequency as `mean` gives it, and the next three as its neighbours let expect, as 2 x 2."""
    met = around(blocks, F.array_repeat(F.col(mean) / 8, 4), width, height)
    blurred = [sum((F.get("cells", F.lit((1 + y + dy) * 4 + 1 + x + dx)) * w for dx, dy, w in symmetric3(*BLUR3)), F.lit(0.0)) for y in (0, 1) for x in (0, 1)]
    expected = let(_sided(F.array(*blurred), halves_to_low()), lambda e: F.array(F.col(mean), F.get(e, F.lit(1)), F.get(e, F.lit(2)), F.get(e, F.lit(3))))
    return met.withColumn("low", expected).drop("cells")


def with_high(blocks: DataFrame, low: str, width: int, height: int) -> DataFrame:
    """blocks with `high`: all 64 frequencies as the 2 x 2 lowest of the blocks around let expect; the 2 x 2 lowest are 0."""
    met = around(blocks, _sided(F.col(low), low_to_halves()), width, height)
    expected = F.transform(_sided(F.col("cells"), enlarged_dct()), lambda v, i: F.when((i < 16) & (i % 8 < 2), 0.0).otherwise(v))
    return met.withColumn("high", expected).drop("cells")


def _decoded_low(low: Column, q: Column, step: float) -> Column:
    return F.array(F.get(low, F.lit(0)), *[F.get(low, F.lit(k)) + F.get(q, F.lit(i)) * step for k, i in enumerate(LOW, 1)])


def encode(blocks: DataFrame, coefficients: str, width: int, height: int, mean_step: float, step: float) -> DataFrame:
    """(image_id, c, by, bx, q): whole numbers for the 64 orthonormal frequencies of 8 x 8 blocks: the first for the mean in
    mean_steps, the others for what differs from the prediction, in steps. width and height of all images are in blocks; a block's place
    occurs once. No blocks give no rows; a null frequency gives a null number."""
    v = F.col(coefficients)
    first = quantise(F.get(v, F.lit(0)), mean_step)
    rows = blocks.select(*KEY, v.alias("v"), first.alias("first"), (first * F.lit(mean_step)).alias("mean"))
    low = with_low(rows, "mean", width, height)
    some = {i: quantise(F.get("v", F.lit(i)) - F.get("low", F.lit(k)), step) for k, i in enumerate(LOW, 1)}
    known = low.withColumn("q", F.array(*[some.get(i, F.lit(0)) for i in range(64)])).withColumn("low", _decoded_low(F.col("low"), F.col("q"), step))
    high = with_high(known, "low", width, height)
    rest = F.zip_with("v", "high", lambda a, b: quantise(a - b, step))
    q = F.transform(rest, lambda r, i: F.when(i == 0, F.col("first")).when((i < 16) & (i % 8 < 2), F.get("q", i)).otherwise(r))
    return high.select(*KEY, q.alias("q"))


def decode(coded: DataFrame, q: str, width: int, height: int, mean_step: float, step: float) -> DataFrame:
    """(image_id, c, by, bx, v): frequencies from the numbers of encode. Each is within half its step."""
    rows = coded.select(*KEY, F.col(q).alias("q"), (F.get(q, F.lit(0)) * F.lit(mean_step)).alias("mean"))
    low = with_low(rows, "mean", width, height).withColumn("low", _decoded_low(F.col("low"), F.col("q"), step))
    high = with_high(low, "low", width, height)
    lowest = lambda i: F.get("low", (F.floor(i / 8) * 2 + i % 8).cast("int"))
    v = F.transform(F.zip_with("q", "high", lambda a, b: a * step + b), lambda x, i: F.when((i < 16) & (i % 8 < 2), lowest(i)).otherwise(x))
    return high.select(*KEY, v.alias("v"))
