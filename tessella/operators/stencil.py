"""Stencils: weighted neighbourhoods of a grid under a border policy.

Weighted sums work on tiles (tessella/operators/tiles.py): a pixel is shuffled once, with copies only near the edges of tiles, and
both passes of a separable kernel run where it lies. Where something other than a sum is formed (largest values,
medians, weights by value) a pixel is sent to the cells that read it, and one aggregate per cell takes what arrives. Nothing is
joined with itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.borders import POLICIES
from tessella.operators import tiles
from tessella.operators.grid import KEY

Taps = Sequence[tuple[int, int, float]]  # (dx, dy, weight): a cell reads (x + dx, y + dy)


def symmetric3(centre: float, side: float, corner: float) -> Taps:
    weight = {0: centre, 1: side, 2: corner}
    return [(dx, dy, weight[abs(dx) + abs(dy)]) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if weight[abs(dx) + abs(dy)]]


def kernel3(rows: Sequence[Sequence[float]]) -> Taps:
    return [(dx, dy, rows[dy + 1][dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if rows[dy + 1][dx + 1]]


def symmetric(radius: int, weights: Sequence[Sequence[float]]) -> Taps:
    """Square kernel given by its quadrant: weights[|dy|][|dx|]."""
    span = range(-radius, radius + 1)
    return [(dx, dy, weights[abs(dy)][abs(dx)]) for dy in span for dx in span if weights[abs(dy)][abs(dx)]]


# Named kernels.
LAPLACIAN3 = symmetric3(-4.0, 1.0, 0.0)
LOWPASS3 = symmetric3(0.36208932, 0.12820096, 0.03127668)
GRAD_X3 = kernel3([[-1, 0, 1]] * 3)
GRAD_Y3 = kernel3([[-1, -1, -1], [0, 0, 0], [1, 1, 1]])
CORNER3 = kernel3([[1, 0, 1], [0, 0, 0], [1, 0, 1]])
LOWPASS5 = (0.03603267, 0.25539268, 0.41714928, 0.25539268, 0.03603267)
GAUSSIAN5_SIGMA1 = (0.06136, 0.24477, 0.38774, 0.24477, 0.06136)
GAUSSIAN5_SIGMA2 = (0.153388, 0.221461, 0.250301, 0.221461, 0.153388)
#: Sides and corners of the smoothing kernel before it is normalised, at its strongest setting.
SMOOTH3 = (0.056007960760453189, 0.045899074552453879)
#: Quadrant of its approximate inverse without the centre: (0,1), (1,1), (0,2), (1,2), (2,2).
SHARPEN5 = (-0.092359145662814029, -0.039253623634014627, 0.016176494530216929, 0.00083458437774987476, 0.004512465323949319)


def gaussian(radius: int, sigma: float) -> list[float]:
    """Sampled Gaussian with sum 1."""
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def _readers(at: Column, d: int, n: int, policy: str) -> Column:
    """Cells whose tap d lands on coordinate `at`: all p with policy(p + d) = at, as an array."""
    inside = lambda p: (p >= 0) & (p < n)
    direct = at - d
    # outside cells land back inside: candidates are within |d| of either end
    ends = sorted({p for p in [*range(min(abs(d), n)), *range(max(0, n - abs(d)), n)] if not 0 <= p + d < n}) if d else []
    fold = POLICIES[policy]
    folded = [F.when(fold(F.lit(p + d), n) == at, F.lit(p)) for p in ends]
    return F.array_compact(F.array(F.when(inside(direct), direct), *folded))


def convolve(pixels: DataFrame, width: int, height: int, taps: Taps, policy: str = "mirror", normalise: bool = False) -> DataFrame:
    """Sum of weight times neighbour; with normalise, divided by the weights that fell inside."""
    return _passes(pixels, width, height, [taps], policy, normalise)


def _passes(pixels: DataFrame, width: int, height: int, passes: Sequence[Taps], policy: str, normalise: bool) -> DataFrame:
    """Stencils one after another, in one shuffle of the cells."""

    def work(given, place):
        (p,) = given
        for taps in passes:
            p = tiles.convolved(p, taps, place, policy, normalise)
        return [p]

    return tiles.over_tiles(pixels, width, height, reach(passes), ["v"], work, ["v"])


def reach(passes: Sequence[Taps]) -> tuple[int, int]:
    """How far stencils one after another look along x and along y."""
    return tuple(sum(max((abs(t[k]) for t in taps), default=0) for taps in passes) for k in range(2))


def along_axes(along_x: Sequence[float], along_y: Sequence[float]) -> list[Taps]:
    """The two passes of a separable kernel."""
    rx, ry = len(along_x) // 2, len(along_y) // 2
    return [[(k - rx, 0, w) for k, w in enumerate(along_x)], [(0, k - ry, w) for k, w in enumerate(along_y)]]


def separable(pixels: DataFrame, width: int, height: int, along_x: Sequence[float], along_y: Sequence[float], policy: str = "mirror", normalise: bool = False) -> DataFrame:
    return _passes(pixels, width, height, along_axes(along_x, along_y), policy, normalise)


def blur_passes(sigma: float) -> list[Taps]:
    radius = max(1, int(math.ceil(2.25 * sigma)))
    w = gaussian(radius, sigma)
    return along_axes(w, w)


def blur(pixels: DataFrame, width: int, height: int, sigma: float, policy: str = "drop") -> DataFrame:
    """Gaussian blur; with the default policy the weights are normalised again at the borders."""
    return _passes(pixels, width, height, blur_passes(sigma), policy, normalise=policy == "drop")


def smooth(pixels: DataFrame, width: int, height: int) -> DataFrame:
    side, corner = SMOOTH3
    mul = 1 / (1 + 4 * (side + corner))
    return convolve(pixels, width, height, symmetric3(mul, side * mul, corner * mul), "mirror")


def sharpen(pixels: DataFrame, width: int, height: int, strength: float = 1.0) -> DataFrame:
    """Approximate inverse of smooth."""
    a, b, c, d, e = (strength * k for k in SHARPEN5)
    return convolve(pixels, width, height, symmetric(2, [[1.0, a, c], [a, b, d], [c, d, e]]), "clamp")


def neighbours(pixels: DataFrame, width: int, height: int, radius: int, l1: bool = False) -> DataFrame:
    """(image_id, c, y, x, dx, dy, v): every cell with the values around it that lie inside the grid."""
    span = range(-radius, radius + 1)
    offsets = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in span for dx in span if not l1 or abs(dx) + abs(dy) <= radius]
    sent = pixels.select("image_id", "c", "y", "x", "v", F.explode(F.array(*offsets)).alias("o"))
    to = sent.select("image_id", "c", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), "v")
    return to.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))


def dilate(pixels: DataFrame, width: int, height: int, radius: int) -> DataFrame:
    """Largest value within city-block distance; a negative radius erodes."""
    pick = F.max if radius >= 0 else F.min
    return neighbours(pixels, width, height, abs(radius), l1=True).groupBy(*KEY).agg(pick("v").alias("v"))


def peak_distance(pixels: DataFrame, width: int, height: int, least: float, radius: int, weight: float) -> DataFrame:
    """Chebyshev distance to the nearest local peak within radius, -1 if there is none."""
    around = neighbours(pixels, width, height, radius).groupBy(*KEY).agg(F.greatest(F.max("v"), F.lit(least)).alias("top"), F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("v"))).alias("v"))
    peaks = around.where(F.col("v") > (1 - weight) * least + weight * F.col("top"))
    reach = neighbours(peaks.select(*KEY, "v"), width, height, radius).groupBy(*KEY).agg(F.min(F.greatest(F.abs("dx"), F.abs("dy"))).alias("d"))
    return pixels.select(*KEY).join(reach, KEY, "left").select(*KEY, F.coalesce(F.col("d"), F.lit(-1)).cast("double").alias("v"))


def lonely(pixels: DataFrame, width: int, height: int, radius: int, share: float = 0.37559546016936962, most: int = 4) -> DataFrame:
    """Cells with at most `most` values of at least share times their own around them, themselves included."""
    around = neighbours(pixels, width, height, radius)
    own = pixels.select(*KEY, F.col("v").alias("own"))
    hits = F.count_if(F.col("v") >= share * F.col("own"))
    return around.join(own, KEY).groupBy(*KEY).agg(F.max("own").alias("v"), hits.alias("hits")).select(*KEY, "v", (F.col("hits") <= most).alias("lonely"))


def gradient2(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Larger of the second differences along x and y; the border takes the nearest inner value's."""
    row, column = Window.partitionBy("image_id", "c", "y").orderBy("x"), Window.partitionBy("image_id", "c", "x").orderBy("y")
    second = lambda w: F.abs(F.lag("v").over(w) + F.lead("v").over(w) - 2 * F.col("v"))
    inner = pixels.withColumn("gx", second(row)).withColumn("gy", second(column)).where((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < width - 1) & (F.col("y") < height - 1)).select(*KEY, F.greatest("gx", "gy").alias("v"))
    xs = F.when(F.col("x") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("x"))
    xs = F.when(F.col("x") == width - 2, F.concat(xs, F.array(F.lit(width - 1)))).otherwise(xs)
    ys = F.when(F.col("y") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("y"))
    ys = F.when(F.col("y") == height - 2, F.concat(ys, F.array(F.lit(height - 1)))).otherwise(ys)
    return inner.withColumn("xs", xs).withColumn("ys", ys).select("image_id", "c", F.explode("ys").alias("y"), "xs", "v").select("image_id", "c", "y", F.explode("xs").alias("x"), "v")


def neighbour_gap(pixels: DataFrame) -> DataFrame:
    """Sum of absolute differences to the right and lower neighbour, per pixel."""
    row, column = Window.partitionBy("image_id", "c", "y").orderBy("x"), Window.partitionBy("image_id", "c", "x").orderBy("y")
    gap = F.coalesce(F.abs(F.lead("v").over(row) - F.col("v")), F.lit(0.0)) + F.coalesce(F.abs(F.lead("v").over(column) - F.col("v")), F.lit(0.0))
    return pixels.withColumn("v", gap)


def block_sad(pixels: DataFrame, width: int, height: int, radius: int, block: int) -> DataFrame:
    """Sum of absolute differences of each block to itself shifted by (dx, dy)."""
    own = pixels.select(*KEY, F.col("v").alias("own"))
    around = neighbours(pixels, width, height, radius).join(own, KEY)
    return around.groupBy("image_id", "c", F.floor(F.col("y") / block).cast("int").alias("by"), F.floor(F.col("x") / block).cast("int").alias("bx"), "dx", "dy").agg(F.sum(F.abs(F.col("v") - F.col("own"))).alias("sad"))


def guided_smooth(pixels: DataFrame, width: int, height: int, radius: int, sigma: float, cap: float = 507.0) -> DataFrame:
    """Edge-preserving filter: neighbours weigh 0.5^(4 d / sigma) with d their difference, capped."""
    own = pixels.select(*KEY, F.col("v").alias("own"))
    w = F.pow(F.lit(0.5), 4 * F.least(F.abs(F.col("v") - F.col("own")), F.lit(cap)) / sigma)
    return neighbours(pixels, width, height, radius).join(own, KEY).groupBy(*KEY).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def subsample(pixels: DataFrame, n: int = 2) -> DataFrame:
    """Mean of n x n boxes; boxes that the border cuts take what there is."""
    return pixels.groupBy("image_id", "c", F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def subsample_chroma(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Integer 2 x 2 means, rounded half up; at an odd edge the last column and row count twice."""
    weight = F.when((F.col("x") == width - 1) & (F.col("x") % 2 == 0), 2).otherwise(1) * F.when((F.col("y") == height - 1) & (F.col("y") % 2 == 0), 2).otherwise(1)
    half = pixels.groupBy("image_id", "c", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
    return half.agg(F.floor((F.sum(weight * F.col("v")) + 2) / 4).cast("int").alias("v"))


def add_supersampled(fine: DataFrame, coarse: DataFrame, w: float) -> DataFrame:
    """fine (1 - 0.3 w) + w coarse[y / 2][x / 2]."""
    up = coarse.select("image_id", "c", F.col("y").alias("hy"), F.col("x").alias("hx"), F.col("v").alias("half"))
    keyed = fine.withColumn("hy", F.floor(F.col("y") / 2).cast("int")).withColumn("hx", F.floor(F.col("x") / 2).cast("int"))
    return keyed.join(up, ["image_id", "c", "hy", "hx"]).select(*KEY, (F.col("v") * (1 - 0.3 * w) + w * F.col("half")).alias("v"))


def catmull_rom(t: float) -> float:
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def lanczos3(t: float) -> float:
    if t == 0:
        return 1.0
    return 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2 if abs(t) < 3 else 0.0


def upsample(pixels: DataFrame, width: int, height: int, factor: int, kernel=catmull_rom, reach: int = 2, policy: str = "mirror") -> DataFrame:
    """Separable interpolation to factor times the size. Each output phase has its own taps, so a pass
    sends a pixel to the outputs it contributes to and sums them."""

    def axis(rows: DataFrame, name: str, n: int) -> DataFrame:
        taps = []
        for phase in range(factor):
            centre = (phase + 0.5) / factor - 0.5
            near = math.floor(centre)
            raw = [(k, kernel(centre - k)) for k in range(near - reach + 1, near + reach + 1)]
            total = sum(w for _, w in raw)
            taps += [(phase, k, w / total) for k, w in raw if w]

        def outputs(phase: int, k: int, w: float) -> Column:
            return F.transform(_readers(F.col(name), k, n, policy), lambda p: F.struct((p * factor + phase).alias("p"), F.lit(float(w)).alias("w")))

        sends = [outputs(*tap) for tap in taps]
        sent = rows.select("*", F.explode(F.concat(*sends)).alias("t"))
        other = [k for k in KEY if k != name]
        return sent.groupBy(*other, F.col("t.p").alias(name)).agg(F.sum(F.col("t.w") * F.col("v")).alias("v")).select(*KEY, "v")

    return axis(axis(pixels, "x", width), "y", height)
