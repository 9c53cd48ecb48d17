"""Maps of whole-numbered factors by which one plane predicts the others: their choice by votes, their bytes, and back.

A factor f from 0 to 255 stands for (f - OFFSET) / SCALE of the main plane. Every cell votes for the interval of factors that bring it
below half a quantisation step, and the factor with most votes wins: counts at the ends of intervals are summed per tile before
they are shuffled, so a tile costs at most 257 rows whatever its size. An image plane takes a factor per tile if those bring clearly more cells to
zero than one factor for all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import histogram, perceptual, predict, quanttables

FACTORS, OFFSET, SCALE = 256, 128, 64
#: By how much tiles of their own must beat one factor for all.
LEAST_GAIN = 0.25
PLANE, TILE = ["image_id", "c"], ["image_id", "c", "ty", "tx"]


def votes(pixels: DataFrame, step: float, main: int = 1, tile: int = 64) -> DataFrame:
    """(image_id, c, ty, tx, first, last): factors that quantise a cell to zero; `first` > `last` if none does or the main plane is 0 there.

    A null cell, and one that the main plane lacks, has no vote.
    """
    place = [F.floor(F.col(a) / tile).cast("int").alias(f"t{a}") for a in "yx"]
    m = pixels.where(F.col("c") == main).select("image_id", "y", "x", F.when(F.col("v") != 0, F.col("v")).alias("m"))
    cells = pixels.where(F.col("c") != main).join(m, ["image_id", "y", "x"], "left")
    ends = [(F.col("v") + side * step / 2) / F.col("m") for side in (-1, 1)]
    first = F.greatest(F.ceil(F.least(*ends) * SCALE + OFFSET), F.lit(0))
    last = F.least(F.floor(F.greatest(*ends) * SCALE + OFFSET), F.lit(FACTORS - 1))
    known = F.col("v").isNotNull() & F.col("m").isNotNull()
    return cells.select("image_id", "c", *place, F.when(known, first).otherwise(1).alias("first"), F.when(known, last).otherwise(0).alias("last"))


def best_factors(pixels: DataFrame, step: float, main: int = 1, tile: int = 64) -> DataFrame:
    """(image_id, c, ty, tx, factor, zeros) of every tile of the other planes; OFFSET, which stands for nothing, where nobody votes."""
    told = votes(pixels, step, main, tile)
    # one row per tile and end, and the plane's counts from those of its tiles; places are one higher, as the operator's first place counts nothing
    chosen = lambda by: histogram.best_interval(told, by, F.col("first") + 1, F.col("last") + 1, FACTORS + 1).select(*by, (F.col("best") - 1).alias("f"), F.col("best_sum").alias("n"))
    whole = chosen(PLANE).withColumnsRenamed({"f": "whole", "n": "whole_n"})
    at_whole = told.join(whole.select(*PLANE, "whole"), PLANE).groupBy(*TILE).agg(F.count_if(F.col("whole").between(F.col("first"), F.col("last"))).alias("here"))
    own = chosen(TILE).join(at_whole, TILE).join(whole, PLANE)
    better = F.sum("n").over(Window.partitionBy(*PLANE)) > (1 + LEAST_GAIN) * F.col("whole_n")
    known = lambda f: F.when(F.col(f) < 0, OFFSET).otherwise(F.col(f))
    return own.select(*TILE, F.when(better, known("f")).otherwise(known("whole")).cast("int").alias("factor"), F.when(better, F.col("n")).otherwise(F.col("here")).cast("long").alias("zeros"))


def map_bytes(factors: DataFrame) -> DataFrame:
    """(image_id, c, across, code): each map in reading order as runs of differences, in hexadecimal, and its tiles to a row.

    The map of one image plane is one row: a byte or two per tile of a bounded size.
    """
    order = Window.partitionBy(*PLANE).orderBy("ty", "tx")
    folded = predict.fold_difference(F.col("factor"), F.coalesce(F.lag("factor").over(order), F.lit(OFFSET)))
    rows = factors.select(*TILE, folded.alias("d")).groupBy(*PLANE).agg((F.max("tx") + 1).alias("across"), F.array_sort(F.collect_list(F.struct("ty", "tx", "d"))).alias("all"))
    return rows.select(*PLANE, "across", quanttables.field_bytes(F.transform("all", lambda s: s["d"])).alias("code"))


def read_map(coded: DataFrame) -> DataFrame:
    """(image_id, c, ty, tx, factor) from map_bytes; an empty code has no tiles."""
    tiles = coded.select(*PLANE, "across", F.posexplode(quanttables.read_field(F.col("code"))).alias("k", "d"))
    upto = F.sum(predict.unfold_difference(F.col("d"), F.lit(0))).over(Window.partitionBy(*PLANE).orderBy("k"))
    return tiles.select(*PLANE, F.floor(F.col("k") / F.col("across")).cast("int").alias("ty"), (F.col("k") % F.col("across")).cast("int").alias("tx"), F.pmod(upto + OFFSET, F.lit(FACTORS)).cast("int").alias("factor"))


def apply_map(pixels: DataFrame, factors: DataFrame, sign: int, main: int = 1, tile: int = 64) -> DataFrame:
    """Other planes plus sign times their factor of the main one: -1 takes the prediction away, +1 brings it back."""
    return perceptual.apply_factors(pixels, factors.select(*TILE, ((F.col("factor") - OFFSET) / SCALE).alias("factor")), sign, main, tile)
