"""Prediction residuals on grids. Encoders see all neighbours, so lags suffice; decoders are kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.grid import KEY


def _neighbours(pixels: DataFrame) -> DataFrame:
    """With n, w and nw, null outside. One sort along the columns gives n; nw is n of the left cell."""
    row, column = Window.partitionBy("image_id", "c", "y").orderBy("x"), Window.partitionBy("image_id", "c", "x").orderBy("y")
    return pixels.withColumn("n", F.lag("v").over(column)).withColumn("w", F.lag("v").over(row)).withColumn("nw", F.lag("n").over(row))


def _half_to_zero(x: Column) -> Column:
    """C's integer halving."""
    return F.when(x >= 0, F.floor(x / 2)).otherwise(F.ceil(x / 2)).cast("int")


def top_left_residual(pixels: DataFrame, default: int) -> DataFrame:
    """v less the mean of the cells above and to the left; the one there is on an edge, default at the origin."""
    both = _half_to_zero(F.col("n") + F.col("w") + 1)
    guess = F.when(F.col("n").isNotNull() & F.col("w").isNotNull(), both).otherwise(F.coalesce(F.col("w"), F.col("n"), F.lit(default)))
    return _neighbours(pixels).select(*KEY, (F.col("v") - guess).alias("v"))


def clamped_gradient(n: Column, w: Column, nw: Column) -> Column:
    """n + w - nw, held between the smallest and the largest of the three."""
    return F.least(F.greatest(n + w - nw, F.least(n, w, nw)), F.greatest(n, w, nw))


def gradient_residual(pixels: DataFrame) -> DataFrame:
    """v less the clamped gradient; on the first row and column less the one neighbour, 0 at the origin."""
    inner = clamped_gradient(F.col("n"), F.col("w"), F.col("nw"))
    guess = F.when(F.col("nw").isNotNull(), inner).otherwise(F.coalesce(F.col("w"), F.col("n"), F.lit(0)))
    return _neighbours(pixels).select(*KEY, (F.col("v") - guess).alias("v"))


def best_predictor(pixels: DataFrame) -> DataFrame:
    """Residual of the cheapest of four predictors, judged by how each did at the left neighbour; the first of equals."""
    seen = _neighbours(pixels)
    fill = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, w, nw = fill("n"), fill("w"), fill("nw")
    guesses = F.array(n, w, F.shiftright((n + w).cast("int"), 1), clamped_gradient(n, w, nw).cast("int"))
    row = Window.partitionBy("image_id", "c", "y").orderBy("x")
    costs = F.transform("guesses", lambda g: F.abs(F.col("v") - g))
    judged = seen.withColumn("guesses", guesses).withColumn("costs", costs).withColumn("before", F.lag("costs").over(row))
    choice = F.coalesce(F.array_position("before", F.array_min("before")), F.lit(1)).cast("int")
    return judged.select(*KEY, (F.col("v") - F.element_at("guesses", choice)).alias("v"), (choice - 1).alias("predictor"))


def fold_difference(v: Column, previous: Column) -> Column:
    """Difference modulo 256, small ones of either sign first."""
    d = F.pmod(v - previous, F.lit(256))
    return F.when(d < 128, 2 * d).otherwise(511 - 2 * d)


def unfold_difference(code: Column, previous: Column) -> Column:
    d = F.when(code % 2 == 0, F.floor(code / 2)).otherwise(F.floor((511 - code) / 2))
    return F.pmod(d + previous, F.lit(256)).cast("int")
