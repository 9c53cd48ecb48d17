"""Grids as tables: pixels(image_id, c, y, x, v) and row form (image_id, c, y, row ARRAY)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.borders import clamp as clamp_border

KEY = ["image_id", "c", "y", "x"]
#: Side of a block, a tile and a group; a group is the unit that kernels work on.
BLOCK, TILE, GROUP = 8, 64, 512


def generate(spark: SparkSession, width: int, height: int, planes: int, v: Column, image_id: int = 0) -> DataFrame:
    """v(x, y, c) over a grid; one range is enumerated, so the grid is made in parallel."""
    i = F.col("id")
    cells = spark.range(width * height * planes).select(F.lit(image_id).cast("long").alias("image_id"), F.floor(i / (width * height)).cast("int").alias("c"), (F.floor(i / width) % height).cast("int").alias("y"), (i % width).cast("int").alias("x"))
    return cells.withColumn("v", v)


@dataclass(frozen=True)
class Rect:
    """Half-open rectangle; `inside` clamps it to a grid."""

    x0: int
    y0: int
    width: int
    height: int

    def inside(self, width: int, height: int) -> Rect:
        return Rect(self.x0, self.y0, max(0, min(self.width, width - self.x0)), max(0, min(self.height, height - self.y0)))

    def sub(self, other: Rect) -> Rect:
        """other, in this rectangle's own coordinates, as a rectangle of the grid."""
        return Rect(self.x0 + other.x0, self.y0 + other.y0, other.width, other.height).inside(self.x0 + self.width, self.y0 + self.height)

    def holds(self) -> Column:
        x, y = F.col("x"), F.col("y")
        return (x >= self.x0) & (x < self.x0 + self.width) & (y >= self.y0) & (y < self.y0 + self.height)


def crop(pixels: DataFrame, rect: Rect) -> DataFrame:
    """The rectangle as a grid of its own, from (0, 0)."""
    return pixels.where(rect.holds()).withColumn("x", F.col("x") - rect.x0).withColumn("y", F.col("y") - rect.y0)


def zipped(a: DataFrame, b: DataFrame, f, keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """f(a.v, b.v) of two grids of one size: an equi-join on position, co-partitioned by it."""
    right = b.select(*keys, F.col("v").alias("w"))
    return a.join(right, list(keys)).select(*keys, f(F.col("v"), F.col("w")).alias("v"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return zipped(a, b, lambda v, w: v - w)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return zipped(a, b, lambda v, w: v + w)


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    return zipped(a, b, lambda v, w: v * w)


def linear_combination(ka: float, a: DataFrame, kb: float, b: DataFrame) -> DataFrame:
    return zipped(a, b, lambda v, w: ka * v + kb * w)


def scale(pixels: DataFrame, k: float) -> DataFrame:
    return pixels.withColumn("v", k * F.col("v"))


def fill(pixels: DataFrame, value: float) -> DataFrame:
    return pixels.withColumn("v", F.lit(value))


def random_fill(pixels: DataFrame, most: float, seed: int) -> DataFrame:
    """Uniform values that depend on position and seed alone, so a retried task makes the same grid."""
    unit = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return pixels.withColumn("v", unit * most)


def truncate(pixels: DataFrame, kind: str = "int") -> DataFrame:
    """C's cast: towards zero."""
    return pixels.withColumn("v", F.col("v").cast(kind))


def normalise(pixels: DataFrame, top: float, by: Sequence[str] = ("image_id", "c")) -> DataFrame:
    """Minimum to maximum of each plane becomes 0 to top; a flat plane becomes 0. Aggregate first, then join the few rows back."""
    ends = pixels.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) * top / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    return pixels.join(ends, list(by)).select(*KEY, scaled.alias("v"))


def set_border(pixels: DataFrame, width: int, height: int, thickness: int, value: float) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    edge = (x < thickness) | (y < thickness) | (x >= width - thickness) | (y >= height - thickness)
    return pixels.withColumn("v", F.when(edge, F.lit(value)).otherwise(F.col("v")))


def threshold(pixels: DataFrame, limit: float) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") > limit, 0).otherwise(1))


def pad_to_multiple(pixels: DataFrame, width: int, height: int, n: int) -> DataFrame:
    """Repeat the last column and row up to multiples of n: border pixels are copied out, nothing is joined."""
    w, h = -(-width // n) * n, -(-height // n) * n
    xs = F.when(F.col("x") == width - 1, F.sequence(F.col("x"), F.lit(w - 1))).otherwise(F.array("x"))
    ys = F.when(F.col("y") == height - 1, F.sequence(F.col("y"), F.lit(h - 1))).otherwise(F.array("y"))
    wide = pixels.select("image_id", "c", "y", F.explode(xs).alias("x"), "v")
    return wide.select("image_id", "c", F.explode(ys).alias("y"), "x", "v")


def expand(pixels: DataFrame, width: int, height: int, out_width: int, out_height: int) -> DataFrame:
    """Enlarge; new cells of a row get the mean of its last three, new rows the mean of the last three rows."""
    x, y = F.col("x"), F.col("y")
    tail = pixels.where(x >= width - 3).groupBy("image_id", "c", "y").agg(F.avg("v").alias("v"))
    right = tail.select("image_id", "c", "y", F.explode(F.sequence(F.lit(width), F.lit(out_width - 1))).alias("x"), "v") if out_width > width else None
    wide = pixels.select(KEY + ["v"]) if right is None else pixels.select(KEY + ["v"]).unionByName(right)
    if out_height <= height:
        return wide
    foot = wide.where(y >= height - 3).groupBy("image_id", "c", "x").agg(F.avg("v").alias("v"))
    return wide.unionByName(foot.select("image_id", "c", F.explode(F.sequence(F.lit(height), F.lit(out_height - 1))).alias("y"), "x", "v"))


def pack(pixels: DataFrame) -> DataFrame:
    """One array per plane in row-major order; a plane is a group's worth of pixels, so it fits one row."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    return pixels.groupBy("image_id", "c").agg(F.transform(cells, lambda s: s["v"]).alias("packed"))


def unpack(packed: DataFrame, width: int) -> DataFrame:
    return packed.select("image_id", "c", F.posexplode("packed").alias("i", "v")).select("image_id", "c", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "v")


def interleave(pixels: DataFrame) -> DataFrame:
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "c", "v")))
    return pixels.groupBy("image_id").agg(F.transform(cells, lambda s: s["v"]).alias("packed"))


def deinterleave(packed: DataFrame, width: int, planes: int = 3) -> DataFrame:
    i = F.col("i")
    cells = packed.select("image_id", F.posexplode("packed").alias("i", "v"))
    return cells.select("image_id", (i % planes).cast("int").alias("c"), F.floor(i / (planes * width)).cast("int").alias("y"), (F.floor(i / planes) % width).cast("int").alias("x"), "v")


def orient(pixels: DataFrame, width: int, height: int, orientation: int) -> DataFrame:
    """The eight orientations of image files, 1 being upright; from 5 on, width and height swap."""
    x, y = F.col("x"), F.col("y")
    fx, fy = width - 1 - x, height - 1 - y
    nx, ny = {1: (x, y), 2: (fx, y), 3: (fx, fy), 4: (x, fy), 5: (y, x), 6: (fy, x), 7: (fy, fx), 8: (y, fx)}[orientation]
    return pixels.select("image_id", "c", ny.alias("y"), nx.alias("x"), "v")


def same_size(a: DataFrame, b: DataFrame) -> DataFrame:
    size = lambda p, n: p.groupBy("image_id").agg(F.struct(F.max("x"), F.max("y")).alias(n))
    return size(a, "p").join(size(b, "q"), "image_id", "full").select("image_id", F.coalesce(F.col("p") == F.col("q"), F.lit(False)).alias("same"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two grids differ, one-sided ones included; none if they are the same."""
    right = b.select(*KEY, F.col("v").alias("w"))
    return a.select(*KEY, "v").join(right, KEY, "full").where(~F.col("v").eqNullSafe(F.col("w")))


def relative_error(a: DataFrame, b: DataFrame, least: float = 1e-12) -> DataFrame:
    """Largest absolute and relative error of b against a."""
    right = b.select(*KEY, F.col("v").alias("w"))
    diff = F.abs(F.col("v") - F.col("w"))
    return a.join(right, KEY).agg(F.max(diff).alias("max_abs"), F.max(F.when(F.abs("v") > least, diff / F.abs("v"))).alias("max_rel"))


def forward_coordinates(x: Column, y: Column, corners: Sequence[float], edge: float) -> tuple[Column, Column]:
    """Bilinear map of a square of side `edge` to the quadrilateral with corners (x0,y0, x1,y0, x0,y1, x1,y1)."""
    u, v = x / edge, y / edge
    mix = lambda k: (1 - u) * (1 - v) * corners[k] + u * (1 - v) * corners[2 + k] + (1 - u) * v * corners[4 + k] + u * v * corners[6 + k]
    return mix(0), mix(1)


def cubic(t: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Four-tap cubic between b and c."""
    return b + 0.5 * t * (c - a + t * (2 * a - 5 * b + 4 * c - d + t * (3 * (b - c) + d - a)))


def bilinear(v00: Column, v01: Column, v10: Column, v11: Column, x: Column, y: Column) -> Column:
    return (v00 * (1 - x) + v01 * x) * (1 - y) + (v10 * (1 - x) + v11 * x) * y


def warp(pixels: DataFrame, width: int, height: int, corners: Sequence[float], edge: float) -> DataFrame:
    """Each cell takes the bilinear mix of the four cells around its mapped place."""
    fx, fy = forward_coordinates(F.col("x"), F.col("y"), corners, edge)
    placed = pixels.select(*KEY, F.floor(fx).cast("int").alias("sx"), F.floor(fy).cast("int").alias("sy"), (fx - F.floor(fx)).alias("tx"), (fy - F.floor(fy)).alias("ty"))
    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])).alias("o")
    wanted = placed.select("*", corner)
    wx = F.when(F.col("o.dx") == 1, F.col("tx")).otherwise(1 - F.col("tx"))
    wy = F.when(F.col("o.dy") == 1, F.col("ty")).otherwise(1 - F.col("ty"))
    taps = wanted.select(*KEY, clamp_border(F.col("sx") + F.col("o.dx"), width).alias("px"), clamp_border(F.col("sy") + F.col("o.dy"), height).alias("py"), (wx * wy).alias("w"))
    source = pixels.select("image_id", "c", F.col("y").alias("py"), F.col("x").alias("px"), "v")
    return taps.join(source, ["image_id", "c", "py", "px"]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def reverse_coordinates(x: Column, y: Column, corners: Sequence[float], edge: float, rounds: int = 10) -> Column:
    """The place that forward_coordinates maps to (x, y), as a struct of u and v, by Newton's method from the middle.

    Each step stays in the square, so places outside its image give a point of its border.
    """

    def step(s: Column, _: Column) -> Column:
        u, v = s["u"], s["v"]
        fx, fy = forward_coordinates(u * edge, v * edge, corners, edge)
        slope = lambda k, w, a, b: (corners[a + k] - corners[k]) * (1 - w) + (corners[6 + k] - corners[b + k]) * w
        xu, xv, yu, yv = slope(0, v, 2, 4), slope(0, u, 4, 2), slope(1, v, 2, 4), slope(1, u, 4, 2)
        det = xu * yv - xv * yu
        inside = lambda w: F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
        return F.struct(inside(u - (yv * (fx - x) - xv * (fy - y)) / det).alias("u"), inside(v - (xu * (fy - y) - yu * (fx - x)) / det).alias("v"))

    start = F.struct(F.lit(0.5).alias("u"), F.lit(0.5).alias("v"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return F.transform(F.array(found), lambda s: F.struct((s["u"] * edge).alias("u"), (s["v"] * edge).alias("v")))[0]


def mixed_at(pixels: DataFrame, places: DataFrame, width: int, height: int) -> DataFrame:
    """Bilinear mix of the four cells around each place (image_id, c, y, x, px, py)."""
    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])).alias("o")
    wanted = places.select("*", corner)
    part = lambda at, d: F.when(F.col(d) == 1, F.col(at) - F.floor(at)).otherwise(1 - (F.col(at) - F.floor(at)))
    taps = wanted.select(*KEY, clamp_border(F.floor("px").cast("int") + F.col("o.dx"), width).alias("sx"), clamp_border(F.floor("py").cast("int") + F.col("o.dy"), height).alias("sy"), (part("px", "o.dx") * part("py", "o.dy")).alias("w"))
    source = pixels.select("image_id", "c", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return taps.join(source, ["image_id", "c", "sy", "sx"]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def warp_back(pixels: DataFrame, width: int, height: int, corners: Sequence[float], edge: float) -> DataFrame:
    """Each cell takes the mix around the place that the forward map sends to it."""
    back = reverse_coordinates(F.col("x"), F.col("y"), corners, edge)
    places = pixels.select(*KEY, back.alias("_b")).select(*KEY, F.col("_b.u").alias("px"), F.col("_b.v").alias("py"))
    return mixed_at(pixels, places, width, height)
