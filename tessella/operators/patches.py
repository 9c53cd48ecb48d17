"""Dictionaries of repeated patches: small windows whose exact content comes up again and again in images.

Every window is formed by sending each cell to the windows that hold it. Windows meet by their content, whichever
image or place they are from; flat ones don't count. Of windows that overlap, the one whose content is more frequent is taken
first. That order is total, so taking the best pieces one after another is the same as rounds in which every
window that is the best of all that overlap it is taken, in all images at once, and its neighbours go. What is taken is
subtracted from the image and kept as (place, number of the patch); adding it back restores the image exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import KEY
from tessella.storage import materialize


def windows(pixels: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """(image_id, c, y, x, content) of every size x size window inside the image, by its first cell; values row after row."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in range(size) for dx in range(size)])
    sent = pixels.select("image_id", "c", "y", "x", "v", F.explode(offsets).alias("o"))
    sent = sent.select("image_id", "c", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), (F.col("o.dy") * size + F.col("o.dx")).alias("i"), "v")
    sent = sent.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") <= height - size) & (F.col("x") <= width - size))
    return sent.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("content"))


def repeated(found: DataFrame, least: int) -> DataFrame:
    """(content, uses) of contents that occur at least `least` times and are not flat; counts are summed before rows move."""
    return found.where(F.array_min("content") != F.array_max("content")).groupBy("content").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= least)


def _overlapping(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """rows sent to every place at which a window would overlap theirs."""
    span = range(1 - size, size)
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in span for dx in span])
    sent = rows.select("image_id", "c", "y", "x", *keep, F.explode(offsets).alias("o"))
    return sent.select("image_id", "c", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), *keep)


def placements(pixels: DataFrame, width: int, height: int, size: int, least: int) -> DataFrame:
    """(image_id, c, y, x, content, uses) of the windows that are taken: by falling uses, then content, then place."""
    found = windows(pixels, width, height, size)
    order: Column = F.struct((-F.col("uses")).alias("n"), "content", F.col("y").alias("at_y"), F.col("x").alias("at_x")).alias("rank")
    alive = materialize(found.join(repeated(found, least), "content").select(*KEY, "content", "uses", order), "patches")
    taken = None
    while not alive.isEmpty():
        best = _overlapping(alive, size, "rank").groupBy(*KEY).agg(F.min("rank").alias("best"))
        chosen = materialize(alive.join(best, KEY).where("rank = best").select(*KEY, "content", "uses"), "patches")
        taken = chosen if taken is None else taken.unionByName(chosen)
        gone = _overlapping(chosen, size).distinct()
        alive = materialize(alive.join(gone, KEY, "left_anti"), "patches")
    return alive.select(*KEY, "content", "uses") if taken is None else taken


def _cells(taken: DataFrame, size: int) -> DataFrame:
    each = taken.select("image_id", "c", "y", "x", F.posexplode("content").alias("i", "p"))
    return each.select("image_id", "c", (F.col("y") + F.floor(F.col("i") / size)).cast("int").alias("y"), (F.col("x") + F.col("i") % size).cast("int").alias("x"), "p")


def subtract(pixels: DataFrame, taken: DataFrame, size: int, sign: int = -1) -> DataFrame:
    """pixels without the patches (or, with sign 1, with them again). Patches don't overlap, so each cell meets at most one."""
    return pixels.join(_cells(taken, size), KEY, "left").select(*KEY, (F.col("v") + sign * F.coalesce(F.col("p"), F.lit(0.0))).alias("v"))
