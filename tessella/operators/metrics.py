"""Error measures of images and the figures of a benchmark run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import KEY
from tessella.operators.stats import floor_quantile

#: Weights of three planes in the squared error.
PLANE_WEIGHTS = (1 / 8, 6 / 8, 1 / 8)
#: Exponent of the distance norm.
NORM = 7


def weighted_squared_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, sum_sq, pixels), planes weighted."""
    weight = F.element_at(F.array(*map(F.lit, PLANE_WEIGHTS)), F.col("c") + 1)
    both = a.join(b.select(*KEY, F.col("v").alias("w")), KEY)
    return both.groupBy("image_id").agg(F.sum(weight * F.pow(F.col("v") - F.col("w"), 2)).alias("sum_sq"), F.count_if(F.col("c") == 0).alias("pixels"))


def psnr(sum_sq: Column, pixels: Column) -> Column:
    """Peak signal to noise of 8-bit values; 99.99 without an error, 0 without a pixel."""
    return F.when(pixels == 0, 0.0).when(sum_sq <= 0, 99.99).otherwise(10 * F.log10(255.0 * 255.0 * pixels / sum_sq))


def squared_difference(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    return a.join(b.select(*KEY, F.col("v").alias("w")), KEY).select(*KEY, (weight * F.pow(F.col("v") - F.col("w"), 2)).alias("v"))


def asymmetric_difference(a: DataFrame, b: DataFrame, above: float, below: float) -> DataFrame:
    """Squared difference plus a squared excess where b leaves the span from 0.4 a to a."""
    v, w = F.col("v"), F.col("w")
    sign = F.when(v < 0, -1).otherwise(1)
    size, seen = F.abs(v), sign * w
    out = F.when(seen < 0.4 * size, 0.4 * size - seen).when(seen > size, seen - size).otherwise(0.0)
    both = a.join(b.select(*KEY, w), KEY) if "w" in b.columns else a.join(b.select(*KEY, F.col("v").alias("w")), KEY)
    return both.select(*KEY, (0.8 * above * F.pow(v - w, 2) + 0.8 * below * out * out).alias("v"))


def difference_map(v: Column) -> Column:
    """Square root with a straight toe, so that its slope stays finite."""
    return F.when(v < 1e-4, 100 * v).otherwise(F.sqrt(v))


def score(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.greatest(F.max("v"), F.lit(0.0)).alias("score"))


# The widths and the level of the logistic that turns a distance into a class.
CLASS_UP, CLASS_DOWN, CLASS_LEVEL = 5.10228441116, 4.96467433842, 0.827108297066


def fuzzy_class(score_: Column) -> Column:
    """2 for no visible difference, falling through CLASS_LEVEL at distance 1 towards 0."""
    near = (2 / (1 + F.exp((score_ - 1) * CLASS_DOWN)) - 1) * (2 - CLASS_LEVEL) + CLASS_LEVEL
    far = 2 / (1 + F.exp((score_ - 1) * CLASS_UP)) * CLASS_LEVEL
    return F.when(score_ < 1, near).otherwise(far)


def fuzzy_inverse(value: float) -> float:
    """The distance whose class is value, above 0 and below 2."""
    if value > CLASS_LEVEL:
        return 1 + math.log(2 / (1 + (value - CLASS_LEVEL) / (2 - CLASS_LEVEL)) - 1) / CLASS_DOWN
    return 1 + math.log(2 * CLASS_LEVEL / value - 1) / CLASS_UP


def tile_norm(pixels: DataFrame, width: int, height: int, tile: int, margin: int) -> DataFrame:
    """16th-power mean of each tile with a margin around it, whose rim weighs 0.98 and corners 0.7, times 1.2.

    A pixel is sent to the tiles whose margin holds it: at most four while the margin is below half a tile.
    """
    tiles = lambda at, n: F.sequence(F.greatest(F.floor((at - margin) / tile), F.lit(0)), F.least(F.floor((at + margin) / tile), F.lit((n - 1) // tile)))
    sent = pixels.select("image_id", "c", "x", "y", "v", F.explode(tiles(F.col("y"), height)).alias("ty")).select("*", F.explode(tiles(F.col("x"), width)).alias("tx"))
    first = lambda t: F.greatest(t * tile - margin, F.lit(0))
    last = lambda t, n: F.least((t + 1) * tile + margin, F.lit(n)) - 1
    rim_x = (F.col("x") == first(F.col("tx"))) | (F.col("x") == last(F.col("tx"), width))
    rim_y = (F.col("y") == first(F.col("ty"))) | (F.col("y") == last(F.col("ty"), height))
    w = F.when(rim_x & rim_y, 0.7).when(rim_x | rim_y, 0.98).otherwise(1.0) if margin else F.lit(1.0)
    return sent.groupBy("image_id", "c", "ty", "tx").agg((1.2 * F.pow(F.sum(w * F.pow("v", F.lit(16))) / F.sum(w), F.lit(1 / 16))).alias("v"))


def report(tasks: DataFrame, p: float = NORM) -> DataFrame:
    """One row per method and a row `Aggregate:` with geometric means over the methods.

    tasks: (method, distance, bytes, pixels, seconds, sum_sq). Quantiles are sorted[floor(p n)], taken from
    running counts of distinct distances, so no method's rows meet in one task.
    """
    main = tasks.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum("pixels").alias("pixels"), F.sum("seconds").alias("seconds"), F.max("distance").alias("max_distance"),
        F.pow(F.avg(F.pow(F.abs("distance"), F.lit(p))), F.lit(1 / p)).alias("p_norm"), F.sum("sum_sq").alias("sum_sq"),
    )
    # the distances' own order is needed twice only: both quantiles come from narrow counts
    q50 = floor_quantile(tasks, "distance", 0.5, ["method"]).withColumnRenamed("quantile", "p50")
    q90 = floor_quantile(tasks, "distance", 0.9, ["method"]).withColumnRenamed("quantile", "p90")
    rows = main.join(q50, "method").join(q90, "method").select(
        "method", F.col("n").cast("double").alias("n"), F.col("pixels").cast("double").alias("pixels"), F.when(F.col("pixels") > 0, F.col("bytes") * 8 / F.col("pixels")).otherwise(0.0).alias("bpp"),
        F.when(F.col("seconds") > 0, F.col("pixels") * 1e-6 / F.col("seconds")).otherwise(0.0).alias("speed"), "max_distance", "p_norm", psnr(F.col("sum_sq"), F.col("pixels")).alias("psnr"), "p50", "p90",
    )
    names = [c for c in rows.columns if c != "method"]
    mean = lambda c: F.coalesce(F.pow(F.lit(2.0), F.avg(F.when(F.col(c) > 0, F.log2(c)))), F.lit(0.0)).alias(c)
    total = rows.agg(*[mean(c) for c in names]).select(F.lit("Aggregate:").alias("method"), *names)
    return rows.unionByName(total)


def approximate_distance(bpp: Column) -> Column:
    """Distance that a bit rate allows, by a fitted power."""
    return 1.704 * F.pow(bpp, F.lit(-0.804))


def target_size(pixels: Column, size: Column, bits_per_pixel: Column) -> Column:
    """Bytes aimed at: an explicit size, else a bit rate, else none."""
    return F.when(size > 0, size).when(bits_per_pixel > 0, (bits_per_pixel * pixels / 8).cast("long"))
