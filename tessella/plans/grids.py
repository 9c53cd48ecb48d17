"""Queries on grids and blocks: embeddings folded into images, and embeddings as 8 x 8 blocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.operators import blocks, grid, kernels, linalg, metrics, predict, stencil
from tessella.plans.sql import GRIDS, fold_sql, grid_sql, plain, stencil_sql, typed

QUERIES: dict = {}
SQL: dict[str, str] = {}
CELL = "image_id:l c:l y:l x:l v:d"


def query(sql: str | None = None, columns: str = CELL, places: int = 6):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir), places)
        if sql:
            SQL[f.__name__] = typed(sql, columns, places)
        return f

    return register


def make(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The values of all embeddings in order, folded into images of one size; the last image is filled up with zeros."""
    of, v, width, height, planes = GRIDS[name]
    cells = width * height * planes
    k = lambda e: F.floor(F.abs(e.cast("double")) * 1000)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if of == "value":
        values = vectors.select("vec_id", F.posexplode("embedding").alias("i", "e")).select((F.col("vec_id") * 64 + F.col("i")).alias("at"), k(F.col("e")).alias("k"))
    else:
        values = vectors.select(F.col("vec_id").alias("at"), F.aggregate("embedding", F.lit(0).cast("long"), lambda total, e: total + k(e)).alias("k"))
    images = values.select(F.expr(f"at div {cells}").alias("image_id")).distinct()
    frame = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("pos"))
    filled = frame.join(values.select("at", F.expr(v).cast("double").alias("v")), F.col("at") == F.col("image_id") * cells + F.col("pos"), "left")
    place = {"c": f"pos div {width * height}", "y": f"pos % {width * height} div {width}", "x": f"pos % {width}"}
    return filled.select("image_id", *[F.expr(e).cast("int").alias(n) for n, e in place.items()], F.coalesce("v", F.lit(0.0)).alias("v"))


def size(name: str) -> tuple[int, int]:
    return GRIDS[name][2:4]


MIX, MIX_B, ODD, DOTS, STEPS = map(grid_sql, ("mix", "mix_b", "odd", "dots", "steps"))
W, H = size("mix")
BOTH = f"{MIX} a JOIN {MIX_B} b USING (image_id, c, y, x)"


# Elementwise --------------------------------------------------------------------------------------------


@query(f"SELECT * FROM {MIX}")
def generate_grid(spark, sf_dir):
    return make(spark, sf_dir, "mix")


@query(f"SELECT image_id, c, y, x, a.v - b.v AS v FROM {BOTH}")
def grid_subtract(spark, sf_dir):
    return grid.subtract(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b"))


@query(f"SELECT image_id, c, y, x, 0.25 * a.v + 0.75 * b.v AS v FROM {BOTH}")
def grid_combine(spark, sf_dir):
    return grid.linear_combination(0.25, make(spark, sf_dir, "mix"), 0.75, make(spark, sf_dir, "mix_b"))


@query(f"SELECT image_id, c, y, x, TRUNC(2.5 * a.v * b.v + a.v + b.v) AS v FROM {BOTH}")
def grid_product(spark, sf_dir):
    a, b = make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b")
    return grid.truncate(grid.add(grid.scale(grid.product(a, b), 2.5), grid.add(a, b)), "long").withColumn("v", F.col("v").cast("double"))


@query(f"SELECT image_id, c, y, x, CASE WHEN high > low THEN (v - low) * 255 / (high - low) ELSE 0 END AS v FROM {MIX} JOIN (SELECT image_id, c, MIN(v) AS low, MAX(v) AS high FROM {MIX} GROUP BY image_id, c) USING (image_id, c)")
def grid_normalise(spark, sf_dir):
    return grid.normalise(make(spark, sf_dir, "mix"), 255.0)


@query(f"SELECT image_id, c, y, x, CASE WHEN x < 2 OR y < 2 OR x >= {W - 2} OR y >= {H - 2} THEN 9 ELSE v END AS v FROM {MIX}")
def border_mask(spark, sf_dir):
    return grid.set_border(make(spark, sf_dir, "mix"), W, H, 2, 9.0)


@query(f"SELECT image_id, c, y, x, CASE WHEN v > 99.5 THEN 0 ELSE 1 END AS v FROM {MIX}", "image_id:l c:l y:l x:l v:l")
def threshold(spark, sf_dir):
    return grid.threshold(make(spark, sf_dir, "mix"), 99.5)


@query(f"SELECT g.image_id, g.c, oy AS y, ox AS x, g.v FROM {ODD} g, (SELECT range AS ox FROM range(16)), (SELECT range AS oy FROM range(8)) WHERE g.x = LEAST(ox, 12) AND g.y = LEAST(oy, 6)")
def pad_to_multiple(spark, sf_dir):
    return grid.pad_to_multiple(make(spark, sf_dir, "odd"), 13, 7, 8)


@query(f"SELECT image_id, c, y - 3 AS y, x - 5 AS x, v FROM {MIX} WHERE x >= 5 AND x < 15 AND y >= 3 AND y < 12")
def crop_rect(spark, sf_dir):
    return grid.crop(make(spark, sf_dir, "mix"), grid.Rect(5, 3, 10, 9).inside(W, H))


@query(f"SELECT image_id, c, COUNT(*) AS n, STRING_AGG(CAST(v AS BIGINT), ',' ORDER BY y * {W} + x) AS line FROM {MIX} GROUP BY ALL", "image_id:l c:l n:l line:s")
def packed_planes(spark, sf_dir):
    """Planes as rows behind one another."""
    packed = grid.pack(make(spark, sf_dir, "mix"))
    (data,) = [f.name for f in packed.schema if f.dataType.typeName() == "array"]
    return packed.select("image_id", "c", F.size(data).alias("n"), F.array_join(F.transform(data, lambda v: v.cast("long").cast("string")), ",").alias("line"))


@query(f"SELECT image_id, c, y, x, v + 1 AS v FROM {MIX}")
def unpacked_planes(spark, sf_dir):
    """Planes from packed rows whose values have grown by one."""
    packed = grid.pack(make(spark, sf_dir, "mix"))
    (data,) = [f.name for f in packed.schema if f.dataType.typeName() == "array"]
    return grid.unpack(packed.withColumn(data, F.transform(data, lambda v: v + 1)), W)


@query(f"SELECT image_id, COUNT(*) AS n, STRING_AGG(CAST(v AS BIGINT), ',' ORDER BY (y * {W} + x) * 3 + c) AS line FROM {MIX} GROUP BY ALL", "image_id:l n:l line:s")
def interleaved_planes(spark, sf_dir):
    """Three planes cell by cell in one row."""
    packed = grid.interleave(make(spark, sf_dir, "mix"))
    (data,) = [f.name for f in packed.schema if f.dataType.typeName() == "array"]
    return packed.select("image_id", F.size(data).alias("n"), F.array_join(F.transform(data, lambda v: v.cast("long").cast("string")), ",").alias("line"))


@query(f"SELECT image_id, c, y, x, v + 1 AS v FROM {MIX}")
def deinterleaved_planes(spark, sf_dir):
    packed = grid.interleave(make(spark, sf_dir, "mix"))
    (data,) = [f.name for f in packed.schema if f.dataType.typeName() == "array"]
    return grid.deinterleave(packed.withColumn(data, F.transform(data, lambda v: v + 1)), W)


@query(f"SELECT image_id, c, x AS y, {H - 1} - y AS x, v FROM {MIX}")
def orient_6(spark, sf_dir):
    return grid.orient(make(spark, sf_dir, "mix"), W, H, 6)


@query(f"SELECT COUNT(*) AS differing FROM {BOTH} WHERE a.v <> b.v", "differing:l")
def same_pixels(spark, sf_dir):
    return grid.differences(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b")).agg(F.count(F.lit(1)).alias("differing"))


@query(f"SELECT MAX(ABS(a.v - b.v)) AS max_abs, MAX(CASE WHEN ABS(a.v) > 1e-12 THEN ABS(a.v - b.v) / ABS(a.v) END) AS max_rel FROM {BOTH}", "max_abs:d max_rel:d")
def max_relative_error(spark, sf_dir):
    return grid.relative_error(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b"))


@query(f"SELECT image_id, c, MIN(v) AS low, MAX(v) AS high, AVG(v) AS mean, SUM(v) AS total, MEDIAN(v) AS median FROM {MIX} WHERE x >= 4 AND x < 20 AND y >= 2 AND y < 10 GROUP BY image_id, c", "image_id:l c:l low:d high:d mean:d total:d median:d")
def plane_statistics(spark, sf_dir):
    inside = make(spark, sf_dir, "mix").where(grid.Rect(4, 2, 16, 8).holds())
    return inside.groupBy("image_id", "c").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.sum("v").alias("total"), F.median("v").alias("median"))


_QUAD = (1.0, 1.0, 20.0, 2.0, 2.0, 20.0, 22.0, 22.0)
_WARP = [f"((1 - x / 23.0) * (1 - y / 23.0) * {_QUAD[k]} + x / 23.0 * (1 - y / 23.0) * {_QUAD[2 + k]} + (1 - x / 23.0) * (y / 23.0) * {_QUAD[4 + k]} + x / 23.0 * (y / 23.0) * {_QUAD[6 + k]})" for k in range(2)]


@query(f"""WITH p AS (SELECT image_id, c, y, x, {_WARP[0]} AS fx, {_WARP[1]} AS fy FROM {MIX}), t AS (SELECT *, LEAST(GREATEST(FLOOR(fx) + dx, 0), {W - 1}) AS px, LEAST(GREATEST(FLOOR(fy) + dy, 0), {H - 1}) AS py, (CASE WHEN dx = 1 THEN fx - FLOOR(fx) ELSE 1 - (fx - FLOOR(fx)) END) * (CASE WHEN dy = 1 THEN fy - FLOOR(fy) ELSE 1 - (fy - FLOOR(fy)) END) AS w FROM p, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
SELECT t.image_id, t.c, t.y, t.x, SUM(t.w * g.v) AS v FROM t JOIN {MIX} g ON g.image_id = t.image_id AND g.c = t.c AND g.x = t.px AND g.y = t.py GROUP BY ALL""")
def warp_bilinear(spark, sf_dir):
    return grid.warp(make(spark, sf_dir, "mix"), W, H, _QUAD, 23.0)


@query(f"WITH w AS (SELECT image_id, c, y, x, v FROM {ODD} UNION ALL SELECT image_id, c, y, nx AS x, AVG(v) AS v FROM {ODD}, (SELECT range AS nx FROM range(13, 16)) WHERE x >= 10 GROUP BY ALL) SELECT image_id, c, y, x, v FROM w UNION ALL SELECT image_id, c, ny AS y, x, AVG(v) AS v FROM w, (SELECT range AS ny FROM range(7, 10)) WHERE y >= 4 GROUP BY ALL")
def expand_grid(spark, sf_dir):
    return grid.expand(make(spark, sf_dir, "odd"), 13, 7, 16, 10)


# Colour -----------------------------------------------------------------------------------------------

_TO_LINEAR = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} <= 10.31475 THEN {0} / 12.92 WHEN {0} >= 255 THEN 255 ELSE POW(({0} / 255 + 0.055) / 1.055, 2.4) * 255 END"
_TO_SRGB = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} >= 255 THEN 255 WHEN {0} <= 10.31475 / 12.92 THEN {0} * 12.92 ELSE (POW({0} / 255, 1 / 2.4) * 1.055 - 0.055) * 255 END"
_RGB = f"(SELECT image_id, y, x, MAX(v) FILTER (WHERE c = 0) AS r, MAX(v) FILTER (WHERE c = 1) AS g, MAX(v) FILTER (WHERE c = 2) AS b FROM {MIX} GROUP BY ALL)"


def _rgb(spark, sf_dir) -> DataFrame:
    return make(spark, sf_dir, "mix").groupBy("image_id", "y", "x").pivot("c", [0, 1, 2]).agg(F.first("v")).toDF("image_id", "y", "x", "r", "g", "b")


@query(f"SELECT image_id, c, y, x, {_TO_LINEAR.format('v')} AS v FROM {MIX}")
def srgb_to_linear(spark, sf_dir):
    return make(spark, sf_dir, "mix").withColumn("v", color.srgb_to_linear(F.col("v")))


@query(f"SELECT image_id, c, y, x, {_TO_SRGB.format('v')} AS v FROM {MIX}")
def linear_to_srgb(spark, sf_dir):
    return make(spark, sf_dir, "mix").withColumn("v", color.linear_to_srgb(F.col("v")))


_CONE = [f"CBRT(GREATEST((r * {m[0]!r} + g * {m[1]!r} + b * {m[2]!r} + {k!r}) / 255, 0))" for m, k in zip(color.ABSORBANCE, color.ABSORBANCE_BIAS, strict=True)]


@query(f"SELECT image_id, y, x, ({_CONE[0]} - {_CONE[1]}) / 2 AS v0, ({_CONE[0]} + {_CONE[1]}) / 2 AS v1, {_CONE[2]} AS v2, r, g, b FROM {_RGB}", "image_id:l y:l x:l v0:d v1:d v2:d r:d g:d b:d")
def xyb_round_trip(spark, sf_dir):
    """Opponent colours, and the linear colours they go back to."""
    rows = _rgb(spark, sf_dir)
    v = color.xyb(F.col("r"), F.col("g"), F.col("b"))
    rows = rows.select("image_id", "y", "x", *[c.alias(f"v{k}") for k, c in enumerate(v)])
    back = color.xyb_to_linear(F.col("v0"), F.col("v1"), F.col("v2"))
    return rows.select("image_id", "y", "x", "v0", "v1", "v2", *[c.alias(n) for c, n in zip(back, "rgb", strict=True)])


_YUV = [f"CAST(GREATEST(0, LEAST(255, FLOOR(0.5 + 255 * ({add!r} + {m[0]!r} * r / 255 + {m[1]!r} * g / 255 + {m[2]!r} * b / 255)))) AS BIGINT)" for m, add in zip(color.YUV709, color.YUV_OFFSET, strict=True)]


@query(f"SELECT image_id, y, x, {_YUV[0]} AS luma, {_YUV[1]} AS u, {_YUV[2]} AS v FROM {_RGB}", "image_id:l y:l x:l luma:l u:l v:l")
def rgb_to_yuv709(spark, sf_dir):
    out = color.rgb_to_yuv(F.col("r") / 255, F.col("g") / 255, F.col("b") / 255)
    return _rgb(spark, sf_dir).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(out, ("luma", "u", "v"), strict=True)])


_BACK = [" + ".join(f"({m!r}) * ({c} / 255.0 - {add!r})" for m, c, add in zip(row, ("luma", "u", "v"), color.YUV_OFFSET, strict=True)) for row in color.inverse3(color.YUV709)]


@query(f"SELECT image_id, y, x, {_BACK[0]} AS r, {_BACK[1]} AS g, {_BACK[2]} AS b FROM (SELECT image_id, y, x, {_YUV[0]} AS luma, {_YUV[1]} AS u, {_YUV[2]} AS v FROM {_RGB})", "image_id:l y:l x:l r:d g:d b:d")
def yuv709_to_rgb(spark, sf_dir):
    """What eight bits of each channel decode to."""
    yuv = color.rgb_to_yuv(F.col("r") / 255, F.col("g") / 255, F.col("b") / 255)
    coded = _rgb(spark, sf_dir).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(yuv, ("p", "q", "s"), strict=True)])
    return coded.select("image_id", "y", "x", *[v.alias(n) for v, n in zip(color.yuv_to_rgb(F.col("p"), F.col("q"), F.col("s")), "rgb", strict=True)])


@query(
    f"SELECT image_id, c, y, x, CASE WHEN v / 255 <= 1 / 12.0 THEN SQRT(3 * v / 255) ELSE 0.17883277 * LN(12 * v / 255 - 0.28466892) + 0.55991073 END AS hlg, POW((0.8359375 + 18.8515625 * POW(v / 255, 0.1593017578125)) / (1 + 18.6875 * POW(v / 255, 0.1593017578125)), 78.84375) AS pq, v / 255 AS from_hlg, v / 255 AS from_pq FROM {MIX}",
    "image_id:l c:l y:l x:l hlg:d pq:d from_hlg:d from_pq:d", 5,
)
def hlg_and_pq(spark, sf_dir):
    u = F.col("v") / 255
    coded = make(spark, sf_dir, "mix").select("image_id", "c", "y", "x", color.hlg_encode(u).alias("hlg"), color.pq_encode(u).alias("pq"))
    return coded.select("*", color.hlg_decode(F.col("hlg")).alias("from_hlg"), color.pq_decode(F.col("pq")).alias("from_pq"))


_A = "(x * 11 + y * 5) % 256"
_MIXED = f"({_A}) / 255.0 * ({_TO_SRGB.format('v')}) + (1 - ({_A}) / 255.0) * ({_TO_SRGB.format('64.0')})"


@query(f"SELECT image_id, c, y, x, CASE WHEN {_A} = 0 THEN 64 WHEN {_A} = 255 THEN v ELSE {_TO_LINEAR.format('m')} END AS v FROM (SELECT *, {_MIXED} AS m FROM {MIX})")
def alpha_blend(spark, sf_dir):
    return make(spark, sf_dir, "mix").withColumn("v", color.alpha_blend(F.col("v"), F.expr(_A).cast("double"), 255, F.lit(64.0)))


_STOPS = ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1), (0.5, 0.5, 1.0), (1.0, 0.5, 0.5), (1.0, 1.0, 0.5), (1, 1, 1), (1, 1, 1))
_HEAT = [f"ROUND(255 * SQRT((1 - m) * {[float(t[k]) for t in _STOPS]}[i + 1] + m * {[float(t[k]) for t in _STOPS]}[i + 2]))" for k in range(3)]


@query(f"SELECT image_id, y, x, {_HEAT[0]} AS r, {_HEAT[1]} AS g, {_HEAT[2]} AS b FROM (SELECT *, GREATEST(0, LEAST(1, a - i)) AS m FROM (SELECT *, CAST(FLOOR(a) AS BIGINT) AS i FROM (SELECT image_id, y, x, LEAST(GREATEST(11 * CASE WHEN v < 100 THEN v / 100 * 0.3 WHEN v < 150 THEN 0.3 + (v / 100 - 1) / 0.5 * 0.15 ELSE 0.45 + (v / 100 - 1.5) / 18 * 0.5 END, 0), 10) AS a FROM {MIX} WHERE c = 0)))", "image_id:l y:l x:l r:l g:l b:l")
def heat_map(spark, sf_dir):
    r, g, b = color.heat(F.col("v") / 100, 1.0, 1.5)
    return make(spark, sf_dir, "mix").where("c = 0").select("image_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


# Stencils ---------------------------------------------------------------------------------------------


def _register_stencil(name: str, taps, policy: str, on: str = "mix"):
    w, h = size(on)

    def run(spark, sf_dir):
        return stencil.convolve(make(spark, sf_dir, on), w, h, taps, policy)

    run.__name__ = name
    query(stencil_sql(grid_sql(on), w, h, taps, policy))(run)


for _name, _taps, _policy, _on in (
    ("laplacian", stencil.LAPLACIAN3, "mirror", "mix"),
    ("gradient_x", stencil.GRAD_X3, "mirror", "mix"),
    ("gradient_y", stencil.GRAD_Y3, "mirror", "odd"),
    ("corner3", stencil.CORNER3, "mirror", "odd"),
    ("lowpass3", stencil.LOWPASS3, "mirror", "mix"),
    ("lowpass3_inner_mirror", stencil.LOWPASS3, "mirror_inner", "odd"),
    ("lowpass3_clamp", stencil.LOWPASS3, "clamp", "odd"),
    ("kernel3", stencil.kernel3([[1, 2, 3], [4, 5, 6], [7, 8, 9]]), "mirror", "odd"),
):
    _register_stencil(_name, _taps, _policy, _on)


def _separable(k):
    n = len(k) // 2
    return [(i - n, j - n, a * b) for i, a in enumerate(k) for j, b in enumerate(k)]


@query(stencil_sql(MIX, W, H, _separable(stencil.GAUSSIAN5_SIGMA1), "mirror"))
def gaussian5_sigma1(spark, sf_dir):
    return stencil.separable(make(spark, sf_dir, "mix"), W, H, stencil.GAUSSIAN5_SIGMA1, stencil.GAUSSIAN5_SIGMA1)


@query(stencil_sql(ODD, 13, 7, _separable(stencil.GAUSSIAN5_SIGMA2), "clamp"))
def gaussian5_sigma2(spark, sf_dir):
    return stencil.separable(make(spark, sf_dir, "odd"), 13, 7, stencil.GAUSSIAN5_SIGMA2, stencil.GAUSSIAN5_SIGMA2, "clamp")


@query(stencil_sql(ODD, 13, 7, _separable(stencil.LOWPASS5), "mirror"))
def lowpass5(spark, sf_dir):
    return stencil.separable(make(spark, sf_dir, "odd"), 13, 7, stencil.LOWPASS5, stencil.LOWPASS5)


@query(stencil_sql(MIX, W, H, _separable(stencil.gaussian(3, 1.2)), "drop", "SUM(k.w * q.v) / SUM(k.w)"))
def blur_renormalised(spark, sf_dir):
    return stencil.blur(make(spark, sf_dir, "mix"), W, H, 1.2)


@query(stencil_sql(MIX, W, H, stencil.symmetric3(*[k / (1 + 4 * sum(stencil.SMOOTH3)) for k in (1.0, *stencil.SMOOTH3)]), "mirror"))
def smooth(spark, sf_dir):
    return stencil.smooth(make(spark, sf_dir, "mix"), W, H)


_S = stencil.SHARPEN5


@query(stencil_sql(MIX, W, H, stencil.symmetric(2, [[1.0, _S[0], _S[2]], [_S[0], _S[1], _S[3]], [_S[2], _S[3], _S[4]]]), "clamp"))
def sharpen(spark, sf_dir):
    return stencil.sharpen(make(spark, sf_dir, "mix"), W, H)


def _around(g: str, where: str) -> str:
    return f"{g} p JOIN {g} q ON p.image_id = q.image_id AND p.c = q.c AND {where}"


@query(f"SELECT p.image_id, p.c, p.y, p.x, MAX(q.v) AS v FROM {_around(DOTS, 'ABS(p.x - q.x) + ABS(p.y - q.y) <= 2')} GROUP BY ALL")
def dilate_l1(spark, sf_dir):
    return stencil.dilate(make(spark, sf_dir, "dots"), 17, 12, 2)


@query(f"SELECT p.image_id, p.c, p.y, p.x, MIN(q.v) AS v FROM {_around(ODD, 'ABS(p.x - q.x) + ABS(p.y - q.y) <= 1')} GROUP BY ALL")
def erode_l1(spark, sf_dir):
    return stencil.dilate(make(spark, sf_dir, "odd"), 13, 7, -1)


_NEAR2 = "ABS(p.x - q.x) <= 2 AND ABS(p.y - q.y) <= 2"
_PEAKS = f"(SELECT image_id, c, y, x FROM (SELECT p.image_id, p.c, p.y, p.x, p.v, GREATEST(MAX(q.v), 50) AS top FROM {_around(ODD, _NEAR2)} GROUP BY ALL) WHERE v > 0.1 * 50 + 0.9 * top)"


@query(f"SELECT p.image_id, p.c, p.y, p.x, COALESCE(MIN(GREATEST(ABS(p.x - q.x), ABS(p.y - q.y))), -1) AS v FROM {ODD} p LEFT JOIN {_PEAKS} q ON p.image_id = q.image_id AND p.c = q.c AND {_NEAR2} GROUP BY p.image_id, p.c, p.y, p.x")
def peak_distance(spark, sf_dir):
    return stencil.peak_distance(make(spark, sf_dir, "odd"), 13, 7, 50.0, 2, 0.9)


@query(f"SELECT p.image_id, p.c, p.y, p.x, p.v, CASE WHEN COUNT(*) FILTER (WHERE q.v >= 0.37559546016936962 * p.v) <= 4 THEN 1 ELSE 0 END AS lonely FROM {_around(ODD, 'ABS(p.x - q.x) <= 3 AND ABS(p.y - q.y) <= 3')} GROUP BY ALL", CELL + " lonely:l")
def lonely_cells(spark, sf_dir):
    return stencil.lonely(make(spark, sf_dir, "odd"), 13, 7, 3).withColumn("lonely", F.col("lonely").cast("int"))


@query(f"""WITH g AS (SELECT * FROM {ODD}), s AS (SELECT p.image_id, p.c, p.y, p.x, GREATEST(ABS(l.v + r.v - 2 * p.v), ABS(u.v + d.v - 2 * p.v)) AS v FROM g p JOIN g l ON p.image_id = l.image_id AND p.c = l.c AND p.y = l.y AND p.x = l.x + 1 JOIN g r ON p.image_id = r.image_id AND p.c = r.c AND p.y = r.y AND p.x = r.x - 1 JOIN g u ON p.image_id = u.image_id AND p.c = u.c AND p.x = u.x AND p.y = u.y + 1 JOIN g d ON p.image_id = d.image_id AND p.c = d.c AND p.x = d.x AND p.y = d.y - 1)
SELECT g.image_id, g.c, g.y, g.x, s.v FROM g JOIN s ON g.image_id = s.image_id AND g.c = s.c AND s.x = LEAST(GREATEST(g.x, 1), 11) AND s.y = LEAST(GREATEST(g.y, 1), 5)""")
def second_gradient(spark, sf_dir):
    return stencil.gradient2(make(spark, sf_dir, "odd"), 13, 7)


@query(f"SELECT p.image_id, p.c, p.y, p.x, COALESCE(ABS(r.v - p.v), 0) + COALESCE(ABS(d.v - p.v), 0) AS v FROM {ODD} p LEFT JOIN {ODD} r ON p.image_id = r.image_id AND p.c = r.c AND p.y = r.y AND r.x = p.x + 1 LEFT JOIN {ODD} d ON p.image_id = d.image_id AND p.c = d.c AND p.x = d.x AND d.y = p.y + 1")
def neighbour_gap(spark, sf_dir):
    return stencil.neighbour_gap(make(spark, sf_dir, "odd"))


@query(f"SELECT image_id, c, y // 8 AS ty, x // 8 AS tx, MAX(v) - MIN(v) AS v FROM {MIX} GROUP BY ALL", "image_id:l c:l ty:l tx:l v:d")
def range_modulation(spark, sf_dir):
    return make(spark, sf_dir, "mix").groupBy("image_id", "c", F.floor(F.col("y") / 8).alias("ty"), F.floor(F.col("x") / 8).alias("tx")).agg((F.max("v") - F.min("v")).alias("v"))


@query(f"SELECT p.image_id, p.c, p.y // 8 AS \"by\", p.x // 8 AS bx, q.x - p.x AS dx, q.y - p.y AS dy, SUM(ABS(p.v - q.v)) AS sad FROM {_around(MIX, 'ABS(p.x - q.x) <= 1 AND ABS(p.y - q.y) <= 1')} GROUP BY ALL", "image_id:l c:l by:l bx:l dx:l dy:l sad:d")
def block_sad(spark, sf_dir):
    return stencil.block_sad(make(spark, sf_dir, "mix"), W, H, 1, 8)


_WEIGHT = "POW(0.5, 4 * LEAST(ABS(p.v - q.v), 507) / 300.0)"


@query(f"SELECT p.image_id, p.c, p.y, p.x, SUM({_WEIGHT} * q.v) / SUM({_WEIGHT}) AS v FROM {_around(ODD, 'ABS(p.x - q.x) <= 2 AND ABS(p.y - q.y) <= 2')} GROUP BY ALL")
def edge_preserving(spark, sf_dir):
    return stencil.guided_smooth(make(spark, sf_dir, "odd"), 13, 7, 2, 300.0)


@query(f"SELECT image_id, c, y // 2 AS y, x // 2 AS x, AVG(v) AS v FROM {ODD} GROUP BY image_id, c, y // 2, x // 2")
def subsample2(spark, sf_dir):
    return stencil.subsample(make(spark, sf_dir, "odd"))


@query("SELECT image_id, c, y // 2 AS y, x // 2 AS x, FLOOR((SUM(v * (CASE WHEN x = 12 THEN 2 ELSE 1 END) * (CASE WHEN y = 6 THEN 2 ELSE 1 END)) + 2) / 4) AS v FROM " + ODD + " GROUP BY image_id, c, y // 2, x // 2", "image_id:l c:l y:l x:l v:l")
def chroma_420(spark, sf_dir):
    return stencil.subsample_chroma(make(spark, sf_dir, "odd"), 13, 7)


@query(f"SELECT f.image_id, f.c, f.y, f.x, f.v * 0.85 + 0.5 * h.v AS v FROM {ODD} f JOIN (SELECT image_id, c, y // 2 AS y, x // 2 AS x, AVG(v) AS v FROM {ODD} GROUP BY image_id, c, y // 2, x // 2) h ON f.image_id = h.image_id AND f.c = h.c AND f.y // 2 = h.y AND f.x // 2 = h.x")
def add_supersampled(spark, sf_dir):
    fine = make(spark, sf_dir, "odd")
    return stencil.add_supersampled(fine, stencil.subsample(fine), 0.5)


def _upsample_sql(grid_: str, w: int, h: int, factor: int, kernel=stencil.catmull_rom, reach: int = 2) -> str:
    taps = []
    for phase in range(factor):
        centre = (phase + 0.5) / factor - 0.5
        near = math.floor(centre)
        raw = [(k, kernel(centre - k)) for k in range(near - reach + 1, near + reach + 1)]
        taps += [f"({phase}, {k}, {v / sum(x for _, x in raw)!r}::DOUBLE)" for k, v in raw]
    t = f"(VALUES {', '.join(taps)})"
    return f"""SELECT g.image_id, g.c, oy * {factor} + b.p AS y, ox * {factor} + a.p AS x, SUM(a.w * b.w * g.v) AS v
FROM (SELECT range AS ox FROM range({w})), (SELECT range AS oy FROM range({h})), {t} AS a(p, k, w), {t} AS b(p, k, w), {grid_} g
WHERE g.x = {fold_sql('ox + a.k', w, 'mirror')} AND g.y = {fold_sql('oy + b.k', h, 'mirror')} GROUP BY ALL"""


@query(_upsample_sql(ODD, 13, 7, 4))
def upsample4(spark, sf_dir):
    return stencil.upsample(make(spark, sf_dir, "odd"), 13, 7, 4)


@query(_upsample_sql(ODD, 13, 7, 8, stencil.lanczos3, 3))
def upsample8_lanczos(spark, sf_dir):
    return stencil.upsample(make(spark, sf_dir, "odd"), 13, 7, 8, stencil.lanczos3, 3)


@query(f"""WITH t AS (SELECT range AS t FROM range(4)), g AS (SELECT * FROM {STEPS}),
s AS (SELECT g.image_id, a.t AS ty, b.t AS tx, g.v, (g.y = GREATEST(a.t * 8 - 2, 0) OR g.y = LEAST(a.t * 8 + 10, 32) - 1) AS ry, (g.x = GREATEST(b.t * 8 - 2, 0) OR g.x = LEAST(b.t * 8 + 10, 32) - 1) AS rx
FROM t a, t b, g WHERE g.y >= a.t * 8 - 2 AND g.y < a.t * 8 + 10 AND g.x >= b.t * 8 - 2 AND g.x < b.t * 8 + 10)
SELECT image_id, 0 AS c, ty, tx, 1.2 * POW(SUM(w * POW(v, 16)) / SUM(w), 1 / 16.0) AS v FROM (SELECT *, CASE WHEN rx AND ry THEN 0.7 WHEN rx OR ry THEN 0.98 ELSE 1 END AS w FROM s) GROUP BY ALL""", "image_id:l c:l ty:l tx:l v:d")
def tile_norm(spark, sf_dir):
    return metrics.tile_norm(make(spark, sf_dir, "steps"), 32, 32, 8, 2)


# Errors -----------------------------------------------------------------------------------------------


@query(f"SELECT image_id, SUM((CASE WHEN c = 1 THEN 0.75 ELSE 0.125 END) * (a.v - b.v) * (a.v - b.v)) AS sum_sq, COUNT(*) FILTER (WHERE c = 0) AS pixels, 10 * LOG10(65025.0 * COUNT(*) FILTER (WHERE c = 0) / SUM((CASE WHEN c = 1 THEN 0.75 ELSE 0.125 END) * (a.v - b.v) * (a.v - b.v))) AS psnr FROM {BOTH} GROUP BY image_id", "image_id:l sum_sq:d pixels:l psnr:d")
def weighted_psnr(spark, sf_dir):
    e = metrics.weighted_squared_error(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b"))
    return e.withColumn("psnr", metrics.psnr(F.col("sum_sq"), F.col("pixels")))


@query(f"SELECT image_id, c, y, x, 0.8 * 0.5 * (a.v - b.v) * (a.v - b.v) + 0.8 * 0.3 * POW(CASE WHEN b.v < 0.4 * a.v THEN 0.4 * a.v - b.v WHEN b.v > a.v THEN b.v - a.v ELSE 0 END, 2) AS v FROM {BOTH}")
def asymmetric_difference(spark, sf_dir):
    return metrics.asymmetric_difference(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b"), 0.5, 0.3)


@query(f"SELECT image_id, c, MAX(CASE WHEN e < 1e-4 THEN 100 * e ELSE SQRT(e) END) AS score FROM (SELECT image_id, c, 1e-4 * (a.v - b.v) * (a.v - b.v) AS e FROM {BOTH}) GROUP BY image_id, c", "image_id:l c:l score:d")
def difference_score(spark, sf_dir):
    d = metrics.squared_difference(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b"), 1e-4)
    return metrics.score(d.withColumn("v", metrics.difference_map(F.col("v"))), ["image_id", "c"])


# Predictors -------------------------------------------------------------------------------------------

_LAGS = f"(SELECT *, LAG(v) OVER (PARTITION BY image_id, c, x ORDER BY y) AS n, LAG(v) OVER (PARTITION BY image_id, c, y ORDER BY x) AS w FROM {MIX})"
_LAGS2 = f"(SELECT *, LAG(n) OVER (PARTITION BY image_id, c, y ORDER BY x) AS nw FROM {_LAGS})"


@query(f"SELECT image_id, c, y, x, v - CASE WHEN n IS NOT NULL AND w IS NOT NULL THEN TRUNC((n + w + 1) / 2) ELSE COALESCE(w, n, 32) END AS v FROM {_LAGS}")
def top_left_predict(spark, sf_dir):
    return predict.top_left_residual(make(spark, sf_dir, "mix"), 32)


@query(f"SELECT image_id, c, y, x, v - CASE WHEN nw IS NOT NULL THEN LEAST(GREATEST(n + w - nw, LEAST(n, w, nw)), GREATEST(n, w, nw)) ELSE COALESCE(w, n, 0) END AS v FROM {_LAGS2}")
def clamped_gradient(spark, sf_dir):
    return predict.gradient_residual(make(spark, sf_dir, "mix"))


@query(
    f"""WITH a AS (SELECT *, COALESCE(LAG(v) OVER (PARTITION BY image_id, c, x ORDER BY y), 0) AS n, COALESCE(LAG(v) OVER (PARTITION BY image_id, c, y ORDER BY x), 0) AS w FROM {MIX}), b AS (SELECT *, COALESCE(LAG(n) OVER (PARTITION BY image_id, c, y ORDER BY x), 0) AS nw FROM a),
g AS (SELECT *, [n, w, FLOOR((n + w) / 2), CASE WHEN nw >= GREATEST(n, w) THEN LEAST(n, w) WHEN nw <= LEAST(n, w) THEN GREATEST(n, w) ELSE n + w - nw END] AS guesses FROM b), k AS (SELECT *, list_transform(guesses, lambda q: ABS(v - q)) AS costs FROM g),
p AS (SELECT *, LAG(costs) OVER (PARTITION BY image_id, c, y ORDER BY x) AS before FROM k), q AS (SELECT *, COALESCE(list_position(before, list_min(before)), 1) AS choice FROM p) SELECT image_id, c, y, x, v - guesses[choice] AS v, choice - 1 AS predictor FROM q""",
    "image_id:l c:l y:l x:l v:d predictor:l",
)
def best_predictor(spark, sf_dir):
    return predict.best_predictor(make(spark, sf_dir, "mix"))


@query(f"SELECT image_id, c, y, x, code, v AS back FROM (SELECT image_id, c, y, x, a.v, CASE WHEN d < 128 THEN 2 * d ELSE 511 - 2 * d END AS code FROM (SELECT *, ((a.v - b.v) % 256 + 256) % 256 AS d, a.v FROM {BOTH}) AS a)", "image_id:l c:l y:l x:l code:d back:d")
def lossless_difference(spark, sf_dir):
    both = make(spark, sf_dir, "mix").join(make(spark, sf_dir, "mix_b").withColumnRenamed("v", "p"), grid.KEY)
    coded = both.withColumn("code", predict.fold_difference(F.col("v"), F.col("p")))
    return coded.select(*grid.KEY, "code", predict.unfold_difference(F.col("code"), F.col("p")).cast("double").alias("back"))


# Blocks -----------------------------------------------------------------------------------------------

_CELLS = "(SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT range AS i FROM range(1, 65)))"
_BASIS = "(SELECT k, j, (CASE WHEN k = 0 THEN SQRT(0.125) ELSE 0.5 END) * COS((2 * j + 1) * k * PI() / 16) AS b FROM (SELECT range AS k FROM range(8)), (SELECT range AS j FROM range(8)))"
_DCT = f"(SELECT v.vec_id, p.k * 8 + q.k AS i, SUM(v.v * p.b * q.b) AS v FROM {_CELLS} v JOIN {_BASIS} p ON p.j = v.i // 8 JOIN {_BASIS} q ON q.j = v.i % 8 GROUP BY ALL)"
_Q = f"(SELECT vec_id, i, CAST(SIGN(v) * FLOOR(ABS(v) / 0.05 + 0.5) AS BIGINT) AS q FROM {_CELLS})"


def _embeddings(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("block"))


def _cells(df: DataFrame, block="block", value: str = "v") -> DataFrame:
    return df.select("vec_id", F.posexplode(block).alias("i", value))


@query(f"SELECT vec_id, i, v FROM {_DCT}", "vec_id:l i:l v:d", 5)
def dct8x8(spark, sf_dir):
    return _cells(_embeddings(spark, sf_dir).withColumn("block", blocks.dct2d(F.col("block"))))


@query(f"SELECT vec_id, i, v FROM {_CELLS}", "vec_id:l i:l v:d", 5)
def dct_round_trip(spark, sf_dir):
    coded = _embeddings(spark, sf_dir).withColumn("block", blocks.dct2d(F.col("block")))
    return _cells(coded.withColumn("block", blocks.idct2d(F.col("block"))))


@query(f"SELECT vec_id, (i % 8) * 8 + i // 8 AS i, v FROM {_CELLS}", "vec_id:l i:l v:d")
def transpose_blocks(spark, sf_dir):
    return _cells(_embeddings(spark, sf_dir).withColumn("block", blocks.transpose_block(F.col("block"), 8)))


_ZIGZAG = ", ".join(f"({i}, {r})" for r, i in enumerate(blocks.zigzag()))


@query(f"SELECT i, ROW_NUMBER() OVER (ORDER BY zeros // 8, z) - 1 AS place FROM (SELECT i, COUNT(*) FILTER (WHERE q = 0) AS zeros FROM {_Q} GROUP BY i) JOIN (VALUES {_ZIGZAG}) t(i, z) USING (i)", "i:l place:l")
def coefficient_order(spark, sf_dir):
    q = _cells(_embeddings(spark, sf_dir)).select(F.lit(0).alias("c"), "i", blocks.quantise(F.col("v"), 0.05).alias("q"))
    return blocks.coefficient_order(q, blocks.zigzag_table(spark)).select("i", "place")


@query(f"SELECT vec_id, i, q, CASE q WHEN 0 THEN 0 WHEN 1 THEN 1 - 0.07005449891748593 WHEN -1 THEN 0.07005449891748593 - 1 ELSE q - 0.145 / q END AS v FROM {_Q}", "vec_id:l i:l q:l v:d")
def quantise_unbias(spark, sf_dir):
    q = _cells(_embeddings(spark, sf_dir)).select("vec_id", "i", blocks.quantise(F.col("v"), 0.05).alias("q"))
    return q.withColumn("v", blocks.unbias(F.col("q"), 1))


@query(f"SELECT vec_id, COUNT(*) FILTER (WHERE q <> 0) AS n FROM {_Q} GROUP BY vec_id", "vec_id:l n:l")
def nonzero_counts(spark, sf_dir):
    q = _embeddings(spark, sf_dir).withColumn("block", F.transform("block", lambda v: blocks.quantise(v, 0.05)))
    return q.select("vec_id", blocks.nonzero(F.col("block")).alias("n"))


@query(f"SELECT vec_id, i, CASE WHEN GREATEST(i % 8, i // 8) < 2 THEN 0 WHEN GREATEST(i % 8, i // 8) < 3 THEN 1 ELSE 2 END AS pass FROM {_CELLS}", "vec_id:l i:l pass:l")
def progressive_split(spark, sf_dir):
    return _cells(_embeddings(spark, sf_dir)).select("vec_id", "i", blocks.progressive_pass(F.col("i")).alias("pass"))


_FIELD = "(SELECT vec_id, ABS(embedding[1])::DOUBLE + 0.01 AS f FROM embeddings)"


@query(f"WITH f AS (SELECT * FROM {_FIELD}), s AS (SELECT GREATEST(1, FLOOR(65536 * (MEDIAN(f) - MAD(f)) / 64)) AS g FROM f) SELECT vec_id, g AS global_scale, GREATEST(1, LEAST(256, FLOOR(65536.0 * f / g + 0.5))) AS q FROM f, s", "vec_id:l global_scale:d q:l")
def quantise_global_scale(spark, sf_dir):
    field = _embeddings(spark, sf_dir).select("vec_id", (F.abs(blocks.dc(F.col("block"))) + 0.01).alias("f"))
    return blocks.quant_field(field, "f").select("vec_id", "global_scale", "q")


@query(f"SELECT vec_id, i, v + GREATEST(LEAST(ROUND(v * 4) / 4 - v, 0.05), -0.05) AS v FROM {_CELLS}", "vec_id:l i:l v:d")
def clamp_correction(spark, sf_dir):
    v = F.col("v")
    return _cells(_embeddings(spark, sf_dir)).select("vec_id", "i", blocks.clamp_correction(v, F.round(v * 4) / 4, F.lit(0.1)).alias("v"))


# Matrices ---------------------------------------------------------------------------------------------

_M = f"(SELECT vec_id AS m, i // 8 AS i, i % 8 AS j, v FROM {_CELLS})"


def _matrix(spark, sf_dir) -> DataFrame:
    return _cells(_embeddings(spark, sf_dir)).select(F.col("vec_id").alias("m"), F.floor(F.col("i") / 8).cast("int").alias("i"), (F.col("i") % 8).cast("int").alias("j"), "v")


@query(f"SELECT a.m, a.i, b.i AS j, SUM(a.v * b.v) AS v FROM {_M} a JOIN {_M} b ON a.m = b.m AND a.j = b.j GROUP BY ALL", "m:l i:l j:l v:d")
def matmul(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return linalg.matmul(a, linalg.transpose(a))


@query(f"SELECT m, i, j, v + CASE WHEN i = j THEN 0.5 ELSE 0 END AS v FROM {_M}", "m:l i:l j:l v:d")
def matrix_add(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    eye = linalg.identity(spark, 8).select("i", "j", "v")
    return linalg.add(a, a.select("m").distinct().join(eye).select("m", "i", "j", "v"), 0.5)


@query(f"SELECT vec_id, SUM(v * v) AS v FROM {_CELLS} GROUP BY vec_id", "vec_id:l v:d")
def dot_product(spark, sf_dir):
    from tessella.functions.lanes import dot

    return _embeddings(spark, sf_dir).select("vec_id", dot(F.col("block"), F.col("block")).alias("v"))


_A9 = [f"(embedding[{k + 1}]::DOUBLE + {2 if k % 4 == 0 else 0})" for k in range(9)]
_COF = [[f"({_A9[(i + 1) % 3 * 3 + (j + 1) % 3]} * {_A9[(i + 2) % 3 * 3 + (j + 2) % 3]} - {_A9[(i + 1) % 3 * 3 + (j + 2) % 3]} * {_A9[(i + 2) % 3 * 3 + (j + 1) % 3]})" for j in range(3)] for i in range(3)]
_DET = " + ".join(f"{_A9[j]} * {_COF[0][j]}" for j in range(3))


@query(f"SELECT vec_id, i - 1 AS i, [{', '.join(_COF[j][i] for i in range(3) for j in range(3))}][i] / ({_DET}) AS v FROM embeddings, (SELECT range AS i FROM range(1, 10))", "vec_id:l i:l v:d", 5)
def inverse3x3(spark, sf_dir):
    """Inverses of matrices of nine values, made well conditioned by twice the unit matrix."""
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    a = F.zip_with(F.slice("block", 1, 9), eye, lambda x, y: x + 2 * y)
    return _embeddings(spark, sf_dir).select("vec_id", F.posexplode(linalg.inverse3(a)).alias("i", "v"))


@query(f"SELECT SUM(v * v) AS trace, (SELECT SUM(s * s) FROM (SELECT SUM(a.v * b.v) AS s FROM {_CELLS} a JOIN {_CELLS} b USING (vec_id) GROUP BY a.i, b.i)) AS squares, 64 AS axes FROM {_CELLS}", "trace:d squares:d axes:l", 3)
def principal_axes(spark, sf_dir):
    """Sum and squares of the eigenvalues of the vectors' second moments: one pass over the table, a 64 x 64 matrix at the driver."""
    values, _ = linalg.eigen(linalg.gram(_embeddings(spark, sf_dir), "block"))
    return spark.createDataFrame([(float(np.sum(values)), float(np.sum(np.square(values))), len(values))], "trace double, squares double, axes int")


# Kernels ----------------------------------------------------------------------------------------------


@query(f"SELECT vec_id, i, LEAST(32767, GREATEST(-32768, CAST(round_even(v * 1000, 0) AS BIGINT))) + 32768 AS v FROM {_CELLS}", "vec_id:l i:l v:l")
def lossless_planes(spark, sf_dir):
    """Each block as 16-bit integers, as the lossless plane code gives them back."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            planes = [np.clip(np.rint(np.asarray(b).reshape(8, 8) * 1000), -32768, 32767).astype(np.int64) + 32768 for b in pdf["block"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "plane": [kernels.lossless_decode(kernels.lossless_encode(p)).ravel().tolist() for p in planes]})

    return _embeddings(spark, sf_dir).mapInPandas(run, "vec_id long, plane array<long>").select("vec_id", F.posexplode("plane").alias("i", "v"))


@query(
    f"WITH s AS (SELECT vec_id, i, LEAST(255, ABS(CAST(round_even(v * 20, 0) AS BIGINT))) AS q FROM {_CELLS}), n AS (SELECT vec_id, q, COUNT(*) AS n FROM s GROUP BY ALL) SELECT vec_id, COUNT(*) AS symbols, SUM(n) AS coded, CEIL(64 * LOG2(64) - SUM(n * LOG2(n)) - 1e-9) AS least FROM n GROUP BY vec_id",
    "vec_id:l symbols:l coded:l least:l",
)
def entropy_code_sizes(spark, sf_dir):
    """Quantised coefficients through each entropy code and back: different symbols, how many come back right from all of them,
    and the bits that no code can do without, which the Huffman code must reach."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for vec_id, block in zip(pdf["vec_id"], pdf["block"], strict=True):
                q = [min(255, abs(int(round(x * 20)))) for x in block]
                counts = np.bincount(q, minlength=256).tolist()
                depths, ans = kernels.huffman_depths(counts), kernels.RangeAns(counts)
                order = np.argsort(q, kind="stable").tolist()
                back = (kernels.huffman_decode(kernels.huffman_encode(q, depths), len(q), depths), ans.decode(ans.encode(q), len(q)), kernels.inverse_move_to_front(kernels.move_to_front(q)))
                right = sum(all(b[k] == x for b in back) for k, x in enumerate(q)) if kernels.lehmer_decode(kernels.lehmer_encode(order)) == order else 0
                used = [n for n in counts if n]
                bits = int(np.ceil(sum(n * np.log2(len(q) / n) for n in used) - 1e-9))
                huffman = sum(n * d for n, d in zip(counts, depths, strict=True))
                rows.append((vec_id, len(used), right, bits if len(used) == 1 or bits <= huffman <= bits + len(q) else -1))
            yield pd.DataFrame(rows, columns=["vec_id", "symbols", "coded", "least"])

    return _embeddings(spark, sf_dir).mapInPandas(run, "vec_id long, symbols long, coded long, least long")


@query(f"SELECT image_id, c, y, x, 255 - v AS v FROM {MIX}")
def image_files(spark, sf_dir):
    """Negatives of images as PNG files in the shared folder, read back through the file source."""
    from tessella.sources import images
    from tessella.storage import local_path, new_folder

    folder = new_folder(spark, "images")
    packed = make(spark, sf_dir, "mix").groupBy("image_id", "c", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: 255 - s["v"]).alias("row"))
    rows = packed.select(F.format_string("%d.png", "image_id").alias("path"), F.lit(W).alias("width"), F.lit(H).alias("height"), F.lit(8).alias("bits"), "c", "y", "row")
    images.write_files(images.encode(rows, "png"), folder)
    local_path(folder)
    read = images.pixels(images.decode(images.files(spark, folder, "*.png")))
    return read.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("image_id"), "c", "y", "x", "v")
