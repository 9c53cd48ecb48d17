"""Queries on what an image codec does between pixels and bits, over the supplied tables and their blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import approx, color, lanes, names
from tessella.operators import blocks, grid, summary, tokens, transforms
from tessella.plans.grids import _CELLS, _DCT, _RGB, MIX, W, H, _cells, _embeddings, _rgb, make
from tessella.plans.sql import plain, typed
from tessella.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, columns: str = "", places: int = 6):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir), places)
        if sql:
            SQL[f.__name__] = typed(sql, columns, places)
        return f

    return register


# Names and texts ----------------------------------------------------------------------------------------

_NAMED = "(SELECT p_partkey AS k, concat_ws('_', ['RGB', 'Gra', 'XYB'][p_partkey % 3 + 1], ['D65', 'EER', 'D50', 'C'][p_partkey % 4 + 1], ['SRG', '202', 'AP1', 'zzz', NULL][p_partkey % 5 + 1], ['Per', 'Rel', 'Abs'][p_partkey // 3 % 3 + 1], ['SRG', 'Lin', 'g0.4545455', 'g7', 'PeQ', 'gx'][p_partkey // 7 % 6 + 1]) AS name FROM part)"


def _named(spark, sf_dir) -> DataFrame:
    pick = lambda at, *values: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    k = F.col("p_partkey")
    name = F.concat_ws("_", pick(k % 3, "RGB", "Gra", "XYB"), pick(k % 4, "D65", "EER", "D50", "C"), pick(k % 5, "SRG", "202", "AP1", "zzz", None), pick(F.floor(k / 3) % 3, "Per", "Rel", "Abs"), pick(F.floor(k / 7) % 6, "SRG", "Lin", "g0.4545455", "g7", "PeQ", "gx"))
    return table(spark, sf_dir, "part").select(k.alias("k"), name.alias("name"))


@query(
    f"""WITH p AS (SELECT k, string_split(name, '_') AS a FROM {_NAMED}), f AS (SELECT k, len(a) AS n, a[1] = 'Gra' AS gray, a[1] AS space, a[2] AS white, CASE WHEN a[1] <> 'Gra' THEN a[3] END AS primaries, CASE WHEN a[1] = 'Gra' THEN a[3] ELSE a[4] END AS intent, CASE WHEN a[1] = 'Gra' THEN a[4] ELSE a[5] END AS transfer FROM p),
g AS (SELECT *, CASE WHEN regexp_full_match(transfer, 'g[0-9]+([.][0-9]+)?') THEN TRY_CAST(substr(transfer, 2) AS DOUBLE) WHEN transfer = 'Lin' THEN 1.0::DOUBLE WHEN transfer = 'SRG' THEN 1 / 2.2::DOUBLE WHEN transfer = 'Ado' THEN 256 / 563::DOUBLE END AS gamma FROM f)
SELECT k, space, white, COALESCE(primaries, '-') AS primaries, COALESCE(intent, '-') AS intent, COALESCE(transfer, '-') AS transfer, COALESCE(gamma, -1) AS gamma, CAST(COALESCE(space IN ('RGB', 'Gra') AND white IN ('D65', 'D60', 'D50', 'EER') AND (gray OR COALESCE(primaries, '') IN ('SRG', '202', 'DCI', 'AP0', 'AP1', 'Ado')) AND COALESCE(intent, '') IN ('Per', 'Rel', 'Sat', 'Abs') AND (COALESCE(transfer, '') IN ('SRG', 'Lin', 'PeQ', 'HLG') OR COALESCE(gamma BETWEEN 0 AND 1, false)) AND n = CASE WHEN gray THEN 4 ELSE 5 END, false) AS BIGINT) AS ok FROM g""",
    "k:l space:s white:s primaries:s intent:s transfer:s gamma:d ok:l",
)
def description_fields(spark, sf_dir):
    """Well-formed and malformed descriptions of encodings, field by field."""
    fields = _named(spark, sf_dir).select("k", names.parse_description(F.col("name")).alias("d")).select("k", "d.*")
    text = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return fields.select("k", "space", "white", text("primaries"), text("intent"), text("transfer"), F.coalesce("gamma", F.lit(-1.0)).alias("gamma"), F.col("ok").cast("long").alias("ok"))


@query("SELECT k, CASE WHEN ABS(g - 1) < 0.001 THEN 'Lin' WHEN ABS(g - 1 / 2.2) < 0.001 THEN 'SRG' WHEN ABS(g - 256 / 563) < 0.001 THEN 'Ado' ELSE printf('g%.7f', g) END AS name, CASE WHEN ABS(g - 1) < 0.001 THEN 'Lin' WHEN ABS(g - 1 / 2.2) < 0.001 THEN 'SRG' WHEN ABS(g - 256 / 563) < 0.001 THEN 'Ado' ELSE '?' END AS transfer FROM (SELECT p_partkey AS k, (p_partkey % 64) / 64::DOUBLE + CASE WHEN p_partkey % 3 = 0 THEN 256 / 563::DOUBLE - (p_partkey % 64) / 64::DOUBLE ELSE 0 END AS g FROM part)", "k:l name:s transfer:s")
def gamma_names(spark, sf_dir):
    k = F.col("p_partkey")
    gamma = F.when(k % 3 == 0, F.lit(256 / 563)).otherwise((k % 64) / 64.0)
    return table(spark, sf_dir, "part").select(k.alias("k"), names.text_from_gamma(gamma).alias("name"), names.transfer_from_gamma(gamma).alias("transfer"))


_XY = "(SELECT event_id AS k, ABS(event_id % 9 - 4) * 0.0004 AS d, event_id % 4 AS kind FROM events)"


@query(f"SELECT k, CASE WHEN d < 0.001 - 1e-9 THEN ['D65', 'D60', 'D50', 'EER'][kind + 1] ELSE '?' END AS white, CASE WHEN d < 0.001 - 1e-9 THEN ['SRG', '202', 'DCI', 'Ado'][kind + 1] ELSE '?' END AS primaries FROM {_XY}", "k:l white:s primaries:s")
def near_chromaticities(spark, sf_dir):
    """Names of white points and primaries that chromaticities, moved by a little, are near to."""
    moved, kind = F.abs(F.col("event_id") % 9 - 4) * 0.0004, (F.col("event_id") % 4 + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), kind)
    whites, prims = [names.WHITE_POINTS[n] for n in ("D65", "D60", "D50", "EER")], [names.PRIMARIES[n] for n in ("SRG", "202", "DCI", "Ado")]
    xy = [pick([w[i] for w in whites]) + moved for i in range(2)]
    six = [pick([p[i] for p in prims]) + moved for i in range(6)]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), names.white_point(*xy).alias("white"), names.primaries(six).alias("primaries"))


@query("SELECT l_orderkey, l_linenumber, l_quantity / (l_quantity + l_discount + l_tax) AS x, l_discount / (l_quantity + l_discount + l_tax) AS y FROM lineitem", "l_orderkey:l l_linenumber:l x:d y:d")
def chromaticity(spark, sf_dir):
    x, y = names.chromaticity(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, len(string_split(p_name, ' ')) AS words, printf('%s has size %d', p_brand, p_size) AS line, lpad(printf('%.2f', p_retailprice), 12, ' ') AS price, p_brand || '/' || p_name AS path, CASE WHEN p_name LIKE 'co%' THEN 1 ELSE 0 END AS magic, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS hint FROM part", "p_partkey:l first_word:s words:l line:s price:s path:s magic:l hint:s")
def text_formats(spark, sf_dir):
    """Splitting, printing, padding, joining of paths, a magic prefix, and the one hint that counts."""
    words = F.split("p_name", " ")
    hints = F.create_map(F.when(F.col("p_partkey") % 2 == 0, "color_space").otherwise("other"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.get(words, F.lit(0)).alias("first_word"), F.size(words).alias("words"), F.format_string("%s has size %d", "p_brand", "p_size").alias("line"), names.format_float(F.col("p_retailprice"), 12, 2).alias("price"),
        names.join_path(F.concat("p_brand", F.lit("/")), F.col("p_name")).alias("path"), names.starts_with_magic(F.encode("p_name", "utf-8"), b"co").cast("int").alias("magic"), names.colour_hint(hints, "none").alias("hint"),
    )


# Elementary functions and lanes ------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, LOG2(l_extendedprice) AS lg, CBRT(l_extendedprice) AS root, (1 + 2 * l_tax + 3 * l_tax * l_tax) / (2 + l_tax) AS ratio FROM lineitem", "l_orderkey:l l_linenumber:l lg:d root:d ratio:d")
def approximations(spark, sf_dir):
    v = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", approx.log2(v).alias("lg"), approx.cube_root(v).alias("root"), approx.rational(F.col("l_tax"), (1, 2, 3), (2, 1)).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, q * t + d AS ma, d - q * t AS nma, q * t - d AS ms, -(q * t) - d AS nms, 1 / q AS rcp, 1 / SQRT(q) AS rsq, CAST(round_even(q * 0.5, 0) AS BIGINT) AS near FROM (SELECT *, l_quantity AS q, l_tax AS t, l_discount AS d FROM lineitem)", "l_orderkey:l l_linenumber:l ma:d nma:d ms:d nms:d rcp:d rsq:d near:l")
def lane_fused(spark, sf_dir):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", lanes.mul_add(q, t, d).alias("ma"), lanes.nmul_add(q, t, d).alias("nma"), lanes.mul_subtract(q, t, d).alias("ms"), lanes.nmul_subtract(q, t, d).alias("nms"),
        lanes.reciprocal(q).alias("rcp"), lanes.reciprocal_sqrt(q).alias("rsq"), lanes.nearest_int(q * 0.5).alias("near"),
    )


@query("SELECT vec_id, i - 1 AS i, (SIGN(embedding[i]) < 0)::BIGINT * 2147483648 + (FLOOR(LOG2(ABS(embedding[i])::DOUBLE)) + 127)::BIGINT * 8388608 + ((ABS(embedding[i])::DOUBLE / POW(2, FLOOR(LOG2(ABS(embedding[i])::DOUBLE))) - 1) * 8388608)::BIGINT AS bits FROM embeddings, (SELECT range AS i FROM range(1, 65)) WHERE embedding[i] <> 0", "vec_id:l i:l bits:l")
def float_bits(spark, sf_dir):
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where("v != 0")
    return cells.select("vec_id", "i", lanes.float_bits(F.col("v")).alias("bits"))


@query(
    """SELECT vec_id, i - 1 AS i, a[i] AS v, a[3] AS same, CASE WHEN i <= 4 THEN a[i + 4] ELSE a[i - 4] END AS halves, CASE WHEN i > 2 THEN a[i - 2] ELSE 0 END AS up, CASE WHEN i <= 5 THEN a[i + 3] ELSE a[i - 5] END AS combined, a[1] % 256 + a[2] % 256 * 256 + a[3] % 256 * 65536 + a[4] % 256 * 16777216 AS word
FROM (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(FLOOR(ABS(x)::DOUBLE * 5000) AS BIGINT)) AS a FROM embeddings), (SELECT range AS i FROM range(1, 9))""",
    "vec_id:l i:l v:l same:l halves:l up:l combined:l word:l",
)
def lane_parts(spark, sf_dir):
    """Broadcast, halves, shifts over lanes and bytes packed to words, on eight lanes of each vector."""
    a = F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(F.abs(x.cast("double")) * 5000).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", a.alias("a"))
    c = F.col("a")
    word = lanes.u32_from_u8(lanes.u8_from_u32(F.slice(c, 1, 4)))
    zipped = F.arrays_zip(c.alias("v"), lanes.broadcast_lane(c, 2).alias("same"), F.concat(lanes.half(c, True), lanes.half(c, False)).alias("halves"), lanes.shift_lanes(c, 2).alias("up"), lanes.combine_shift_right(c, c, 3).alias("combined"))
    return rows.select("vec_id", F.posexplode(zipped).alias("i", "z"), word.alias("word")).select("vec_id", "i", "z.*", "word")


# Colour -------------------------------------------------------------------------------------------------

_LIN = "(CASE WHEN {0} / 255 <= 10.31475 / 255 THEN {0} / 255 / 12.92 ELSE POW(({0} / 255 + 0.055) / 1.055, 2.4) END)"
_RESPONSE = [" + ".join(f"{row[k]!r} * {_LIN.format(c)}" for k, c in enumerate("rgb")) for row in color.OPSIN_YUV]
_TOED = [f"(CASE WHEN {r} < {color.OPSIN_TOE / color.OPSIN_SLOPE!r} THEN ({r}) * {color.OPSIN_SLOPE} ELSE CBRT({r}) * 1.08 - 0.08 END)" for r in _RESPONSE]


@query(
    f"""WITH c AS (SELECT image_id, y, x, {color.OPSIN_YUV_RED} * {_TOED[0]} AS m, {2 - color.OPSIN_YUV_RED!r} * {_TOED[1]} AS n, {_TOED[2]} AS o FROM {_RGB})
SELECT image_id, y, x, GREATEST(0, LEAST(255, FLOOR(0.5 + 255 * (0.0625 + 219 / 255.0 * (m + n) / 2)))) AS luma, GREATEST(0, LEAST(255, FLOOR(0.5 + 255 * (0.5 + 56 / 255.0 * (o - (m + n) / 2))))) AS u, GREATEST(0, LEAST(255, FLOOR(0.5 + 255 * (0.5 + 33.6 / 255.0 * ((m - n) / 2 - {color.OPSIN_YUV_CENTRE}) / {color.OPSIN_YUV_RADIUS})))) AS v FROM c""",
    "image_id:l y:l x:l luma:l u:l v:l",
)
def rgb_to_opsin_yuv(spark, sf_dir):
    out = color.opsin_yuv(F.col("r") / 255, F.col("g") / 255, F.col("b") / 255, cube_root=approx.libm_cube_root)
    return _rgb(spark, sf_dir).select("image_id", "y", "x", *[c.alias(n) for c, n in zip(out, ("luma", "u", "v"), strict=True)])


@query(f"SELECT image_id, y, x, ROUND(r / 255, 4) AS r, ROUND(g / 255, 4) AS g, ROUND(b / 255, 4) AS b FROM {_RGB}", "image_id:l y:l x:l r:d g:d b:d", 4)
def yuv_opsin_round_trip(spark, sf_dir):
    """The inverse at 30 bits, where rounding is out of the way."""
    rgb = _rgb(spark, sf_dir).select("*", *[c.cast("double").alias(n) for c, n in zip(color.opsin_yuv(F.col("r") / 255, F.col("g") / 255, F.col("b") / 255, 30), ("p", "q", "s"), strict=True)])
    back = color.opsin_yuv_to_rgb(F.col("p"), F.col("q"), F.col("s"), 30)
    return rgb.select("image_id", "y", "x", *[F.round(v, 4).alias(n) for v, n in zip(back, "rgb", strict=True)])


_TO_WIDE = color.between_spaces(names.PRIMARIES["SRG"], names.PRIMARIES["202"], names.WHITE_POINTS["D65"])


@query(f"SELECT image_id, y, x, CAST(FLOOR(0.5 + LEAST(255, GREATEST(0, 12 * ({_TO_WIDE[0][0]!r} * r + {_TO_WIDE[0][1]!r} * g + {_TO_WIDE[0][2]!r} * b) / 12))) AS BIGINT) AS wide_r, {_TO_WIDE[1][0]!r} * r + {_TO_WIDE[1][1]!r} * g + {_TO_WIDE[1][2]!r} * b AS wide_g, {_TO_WIDE[2][0]!r} * r + {_TO_WIDE[2][1]!r} * g + {_TO_WIDE[2][2]!r} * b AS wide_b FROM {_RGB}", "image_id:l y:l x:l wide_r:l wide_g:d wide_b:d")
def wide_gamut(spark, sf_dir):
    """Linear light from sRGB's primaries to BT.2020's, one channel narrowed to bytes."""
    same = lambda v: v
    r, g, b = color.transform((F.col("r"), F.col("g"), F.col("b")), _TO_WIDE, same, same)
    light = _rgb(spark, sf_dir)
    return light.select("image_id", "y", "x", F.floor(0.5 + F.least(F.lit(255.0), F.greatest(F.lit(0.0), r))).cast("long").alias("wide_r"), g.alias("wide_g"), b.alias("wide_b"))


_QUAD, _EDGE = (1.0, 1.0, 20.0, 2.0, 2.0, 13.0, 22.0, 15.0), 23.0
_MAP = [f"((1 - x / 23.0) * (1 - y / 23.0) * {_QUAD[k]} + x / 23.0 * (1 - y / 23.0) * {_QUAD[2 + k]} + (1 - x / 23.0) * (y / 23.0) * {_QUAD[4 + k]} + x / 23.0 * (y / 23.0) * {_QUAD[6 + k]})" for k in range(2)]


@query(f"SELECT image_id, c, y, x, {_MAP[0]} AS fx, {_MAP[1]} AS fy, x AS u, y AS v FROM {MIX}", "image_id:l c:l y:l x:l fx:d fy:d u:d v:d", 5)
def warp_places(spark, sf_dir):
    """Where cells go, and where the way back leads."""
    fx, fy = grid.forward_coordinates(F.col("x"), F.col("y"), _QUAD, _EDGE)
    placed = make(spark, sf_dir, "mix").select("image_id", "c", "y", "x", fx.alias("fx"), fy.alias("fy"))
    back = grid.reverse_coordinates(F.col("fx"), F.col("fy"), _QUAD, _EDGE)
    return placed.withColumn("back", back).select("image_id", "c", "y", "x", "fx", "fy", F.col("back.u").alias("u"), F.col("back.v").alias("v"))


_UP = "LEAST(GREATEST((12 * (x - 1) - (y - 1)) / 227.0, 0), 1) * 23"
_VP = "LEAST(GREATEST((19 * (y - 1) - (x - 1)) / 227.0, 0), 1) * 23"


@query(f"""WITH p AS (SELECT image_id, c, y, x, {_UP} AS fx, {_VP} AS fy FROM {MIX}), t AS (SELECT *, LEAST(GREATEST(FLOOR(fx) + dx, 0), {W - 1}) AS px, LEAST(GREATEST(FLOOR(fy) + dy, 0), {H - 1}) AS py, (CASE WHEN dx = 1 THEN fx - FLOOR(fx) ELSE 1 - (fx - FLOOR(fx)) END) * (CASE WHEN dy = 1 THEN fy - FLOOR(fy) ELSE 1 - (fy - FLOOR(fy)) END) AS w FROM p, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
SELECT t.image_id, t.c, t.y, t.x, SUM(t.w * g.v) AS v FROM t JOIN {MIX} g ON g.image_id = t.image_id AND g.c = t.c AND g.x = t.px AND g.y = t.py GROUP BY ALL""", "image_id:l c:l y:l x:l v:d", 4)
def warp_back(spark, sf_dir):
    """The way back from a parallelogram, whose inverse SQL can say in closed form."""
    return grid.warp_back(make(spark, sf_dir, "mix"), W, H, (1.0, 1.0, 20.0, 2.0, 2.0, 13.0, 21.0, 14.0), 23.0)


# Blocks and strategies ----------------------------------------------------------------------------------


def _basis_sql(n: int) -> str:
    return f"(SELECT k, j, (CASE WHEN k = 0 THEN SQRT(1.0 / {n}) ELSE SQRT(2.0 / {n}) END) * COS((2 * j + 1) * k * PI() / {2 * n}) AS b FROM (SELECT range AS k FROM range({n})), (SELECT range AS j FROM range({n})))"


@query("SELECT n, k, CASE WHEN k = 0 THEN SQRT(1.0 / n) ELSE SQRT(2.0 / n) * COS(k * PI() / (2 * n)) END AS scale, CASE WHEN k = 0 THEN 1 ELSE SQRT(2.0) / n * (SELECT SUM(ABS(COS((2 * j + 1) * k * PI() / (2 * n)))) FROM (SELECT range AS j FROM range(32)) WHERE j < n) END AS norm FROM (SELECT UNNEST([2, 4, 8, 16, 32]) AS n), (SELECT range AS k FROM range(32)) WHERE k < n", "n:l k:l scale:d norm:d")
def transform_constants(spark, sf_dir):
    """Scales and relative absolute sums of the cosines of each size."""
    rows = [(n, k, s, norm) for n in (2, 4, 8, 16, 32) for k, (s, norm) in enumerate(zip(transforms.scales(n), transforms.l1_norms(n), strict=True))]
    return spark.createDataFrame(rows, "n int, k int, scale double, norm double")


def _parted_sql(side: int) -> str:
    b = _basis_sql(side)
    return f"(SELECT v.vec_id, (v.i // 8 // {side} * {side} + p.k) * 8 + v.i % 8 // {side} * {side} + q.k AS i, SUM(v.v * p.b * q.b) AS v FROM {_CELLS} v JOIN {b} p ON p.j = v.i // 8 % {side} JOIN {b} q ON q.j = v.i % 8 % {side} GROUP BY ALL)"


def _register_strategy(name: str, strategy: int, sql: str):
    def run(spark, sf_dir):
        return _cells(_embeddings(spark, sf_dir).select("vec_id", transforms.forward(F.col("block"), strategy).alias("block")))

    run.__name__ = name
    query(f"SELECT vec_id, i, v FROM {sql}", "vec_id:l i:l v:d", 5)(run)


_register_strategy("dct2x2", 2, _parted_sql(2))
_register_strategy("dct4x4", 3, _parted_sql(4))
_register_strategy("identity_block", 1, _CELLS)


@query(f"SELECT vec_id, i, v FROM {_CELLS}", "vec_id:l i:l v:d", 5)
def small_transforms_inverted(spark, sf_dir):
    """Blocks from their 2 x 2 and 4 x 4 coefficients; the two must agree with the block."""
    two, four = (transforms.inverse(transforms.forward(F.col("block"), s), s) for s in (2, 3))
    both = _embeddings(spark, sf_dir).select("vec_id", F.zip_with(two, four, lambda a, b: (a + b) / 2).alias("block"))
    return _cells(both)


_BIG = "(SELECT vec_id // 4 AS m, (vec_id % 4 // 2 * 8 + i // 8) * 16 + vec_id % 2 * 8 + i % 8 AS i, v FROM " + _CELLS + " WHERE vec_id // 4 < (SELECT COUNT(*) // 4 FROM embeddings))"


def _mosaic(spark, sf_dir) -> DataFrame:
    """Blocks of 16 x 16 values, each made of four vectors."""
    four = _embeddings(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 4).alias("m")).agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id"), F.col("block")))).alias("b"), F.count(F.lit(1)).alias("n")).where("n = 4")
    order = [(y // 8 * 2 + x // 8, y % 8 * 8 + x % 8) for y in range(16) for x in range(16)]
    return four.select("m", lanes.let(F.transform("b", lambda s: s["block"]), lambda b: F.array(*[F.get(F.get(b, F.lit(k)), F.lit(i)) for k, i in order])).alias("block"))


@query(f"SELECT v.m, p.k * 16 + q.k AS i, SUM(v.v * p.b * q.b) AS v FROM {_BIG} v JOIN {_basis_sql(16)} p ON p.j = v.i // 16 JOIN {_basis_sql(16)} q ON q.j = v.i % 16 GROUP BY ALL", "m:l i:l v:d", 5)
def dct16x16(spark, sf_dir):
    return _mosaic(spark, sf_dir).select("m", F.posexplode(blocks.dct2d(F.col("block"), 16)).alias("i", "v"))


@query(f"SELECT m, i // 16 % 2 * 2 + i % 16 % 2 AS b, i // 16 // 2 * 8 + i % 16 // 2 AS i, v FROM {_BIG}", "m:l b:l i:l v:d")
def scattered_blocks(spark, sf_dir):
    """A large block as four interleaved small ones."""
    small = _mosaic(spark, sf_dir).select("m", F.posexplode(transforms.scatter(F.col("block"), 16)).alias("b", "small"))
    return small.select("m", "b", F.posexplode("small").alias("i", "v"))


@query(f"SELECT m, i, 2 * v AS v FROM {_BIG}", "m:l i:l v:d")
def gathered_blocks(spark, sf_dir):
    """Back to the large block, from small ones that were doubled on the way."""
    small = F.transform(transforms.scatter(F.col("block"), 16), lambda s: F.transform(s, lambda v: 2 * v))
    return _mosaic(spark, sf_dir).select("m", F.posexplode(transforms.gather(small, 16)).alias("i", "v"))


_KEEP = [1.0, math.sin(math.pi / 4) / (8 * math.sin(math.pi / 32))]
_DC4 = f"(SELECT vec_id // 4 AS m, vec_id % 4 // 2 AS y, vec_id % 2 AS x, SUM(v) / 8 AS v FROM {_CELLS} WHERE vec_id // 4 < (SELECT COUNT(*) // 4 FROM embeddings) GROUP BY ALL)"


@query(f"SELECT m, p.k * 2 + q.k AS i, SUM(v * p.b * q.b) / ([{_KEEP[0]!r}, {_KEEP[1]!r}][p.k + 1] * [{_KEEP[0]!r}, {_KEEP[1]!r}][q.k + 1]) AS llf FROM {_DC4} d JOIN {_basis_sql(2)} p ON p.j = d.y JOIN {_basis_sql(2)} q ON q.j = d.x GROUP BY m, p.k, q.k", "m:l i:l llf:d")
def lowest_frequencies(spark, sf_dir):
    """The four lowest frequencies of 16 x 16 blocks from the means of their quarters."""
    return _quarter_means(spark, sf_dir).select("m", F.posexplode(transforms.lowest_from_dc(F.col("dc"), 2)).alias("i", "llf"))


def _quarter_means(spark, sf_dir) -> DataFrame:
    means = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("m"), "vec_id", (lanes.sum_of_lanes(F.col("block")) / 8).alias("v"))
    return means.groupBy("m").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("dc")).where(F.size("dc") == 4)


@query(f"SELECT m, y * 2 + x AS i, v FROM {_DC4}", "m:l i:l v:d")
def means_from_lowest(spark, sf_dir):
    back = transforms.dc_from_lowest(transforms.lowest_from_dc(F.col("dc"), 2), 2)
    return _quarter_means(spark, sf_dir).select("m", F.posexplode(back).alias("i", "v"))


_STEP = 0.05
_COST = "SUM(CASE WHEN FLOOR(ABS(v) / 0.05 + 0.5) > 0 THEN 1 + 2 * LOG2(FLOOR(ABS(v) / 0.05 + 0.5) + 1) ELSE 0 END)"
_PRICED = " UNION ALL ".join(f"SELECT vec_id, {k} AS strategy, ROUND({_COST}, 6) AS cost FROM {sql} GROUP BY vec_id" for k, sql in ((0, _DCT), (1, _CELLS), (2, _parted_sql(2)), (3, _parted_sql(4))))
_BEST = f"(SELECT vec_id, MIN_BY(strategy, cost * 10 + strategy * 1e-7) AS strategy, MIN(cost) AS cost FROM ({_PRICED}) GROUP BY vec_id)"


def _best(spark, sf_dir) -> DataFrame:
    return transforms.best_strategy(_embeddings(spark, sf_dir), "block", _STEP)


@query(f"SELECT vec_id, cost FROM {_BEST}", "vec_id:l cost:d", 4)
def best_strategy_cost(spark, sf_dir):
    """What the cheapest of four transforms costs each block."""
    return _best(spark, sf_dir).select("vec_id", "cost")


@query(f"SELECT strategy, COUNT(*) AS blocks, CASE WHEN strategy BETWEEN 0 AND 8 THEN 1 ELSE 0 END AS valid FROM {_BEST} GROUP BY strategy", "strategy:l blocks:l valid:l")
def strategy_counts(spark, sf_dir):
    return _best(spark, sf_dir).groupBy("strategy").agg(F.count(F.lit(1)).alias("blocks"), F.max(transforms.valid_strategy(F.col("strategy")).cast("int")).alias("valid"))


# Tokens ---------------------------------------------------------------------------------------------------

_FIELD = "(SELECT vec_id // 64 AS image_id, vec_id % 64 // 8 AS \"by\", vec_id % 8 AS bx, CAST(FLOOR(ABS(embedding[1]::DOUBLE) * 900) AS BIGINT) + 1 AS q FROM embeddings)"
_NEAR = f"(SELECT *, LAG(q) OVER (PARTITION BY image_id, bx ORDER BY \"by\") AS top, LAG(q) OVER (PARTITION BY image_id, \"by\" ORDER BY bx) AS lft FROM {_FIELD})"
_RESIDUAL = "q - CASE WHEN top IS NOT NULL AND lft IS NOT NULL THEN (top + lft + 1) // 2 ELSE COALESCE(top, lft, 32) END"


def _field(spark, sf_dir) -> DataFrame:
    k = F.col("vec_id")
    return _embeddings(spark, sf_dir).select(F.floor(k / 64).alias("image_id"), F.floor(k % 64 / 8).alias("by"), (k % 8).alias("bx"), (F.floor(F.abs(F.get("block", F.lit(0))) * 900) + 1).cast("long").alias("q"))


@query(f"SELECT image_id, \"by\", bx, LEAST(p, 255) AS token, CASE WHEN p >= 255 THEN q - 1 ELSE -1 END AS extra FROM (SELECT *, CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END AS p FROM (SELECT *, {_RESIDUAL} AS r FROM {_NEAR}))", "image_id:l by:l bx:l token:l extra:l")
def quant_field_tokens(spark, sf_dir):
    """Residuals of a field of quantisation steps against the blocks above and to the left."""
    return tokens.field_tokens(_field(spark, sf_dir), "q").withColumn("extra", F.coalesce("extra", F.lit(-1)))


@query(f"SELECT image_id, \"by\", bx, q % 9 AS token FROM {_FIELD} WHERE bx % 2 = 0 AND \"by\" % 2 = 0", "image_id:l by:l bx:l token:l")
def strategy_tokens(spark, sf_dir):
    """Tokens of strategies: only blocks that begin one have any."""
    field = _field(spark, sf_dir).withColumn("strategy", F.col("q") % 9)
    return tokens.strategy_tokens(field, "strategy", (F.col("bx") % 2 == 0) & (F.col("by") % 2 == 0)).select("image_id", "by", "bx", "token")


_ORDER = "[" + ", ".join(map(str, blocks.zigzag())) + "]"
_SCAN = f"(SELECT vec_id, k - 1 AS place, CAST(SIGN(v) * FLOOR(ABS(v) * 20 + 0.5) AS BIGINT) AS q FROM (SELECT vec_id, k, embedding[{_ORDER}[k] + 1]::DOUBLE AS v FROM embeddings, (SELECT range AS k FROM range(1, 65))))"
_TOKENS = f"(SELECT vec_id, place, place - COALESCE(LAG(place) OVER w, 0) - 1 AS run, CASE WHEN q > 0 THEN 2 * q ELSE -2 * q - 1 END AS value, COUNT(*) OVER (PARTITION BY vec_id ORDER BY place DESC) AS lft FROM {_SCAN} WHERE q <> 0 AND place > 0 WINDOW w AS (PARTITION BY vec_id ORDER BY place))"
_CONTEXT = "CAST(LEAST(FLOOR(LOG2(lft)), 7) * 8 + LEAST(FLOOR(LOG2(place)), 7) AS BIGINT)"


def _tokens(spark, sf_dir) -> DataFrame:
    """Every token of every block, with its context."""
    q = F.transform("block", lambda v: (F.signum(v) * F.floor(F.abs(v) * 20 + 0.5)).cast("long"))
    rows = _embeddings(spark, sf_dir).select("vec_id", F.explode(tokens.coefficient_tokens(tokens.scanned(q, blocks.zigzag()))).alias("t"))
    return rows.select("vec_id", "t.*").withColumn("context", tokens.token_context(F.col("left"), F.col("place")))


@query(f"SELECT vec_id, place, run, value, lft AS \"left\", {_CONTEXT} AS context FROM {_TOKENS}", "vec_id:l place:l run:l value:l left:l context:l")
def coefficient_tokens(spark, sf_dir):
    """Zero runs and values of quantised blocks in scan order, each with its context."""
    return _tokens(spark, sf_dir)


@query(f"SELECT context, value, COUNT(*) AS n FROM (SELECT *, {_CONTEXT} AS context FROM {_TOKENS}) GROUP BY ALL", "context:l value:l n:l")
def context_histograms(spark, sf_dir):
    return tokens.context_histograms(_tokens(spark, sf_dir), "context", "value")


@query(f"SELECT cluster, SUM(n) AS n, SUM(n) * LOG2(SUM(n)) - SUM(n * LOG2(n)) AS bits FROM (SELECT LEAST(context // 8, 7) AS cluster, value, COUNT(*) AS n FROM (SELECT *, {_CONTEXT} AS context FROM {_TOKENS}) GROUP BY ALL) GROUP BY cluster", "cluster:l n:l bits:d", 3)
def context_bits(spark, sf_dir):
    """Bits of all tokens under a fixed clustering of their contexts."""
    clustered = _tokens(spark, sf_dir).withColumn("cluster", tokens.static_context(F.col("context")))
    return tokens.context_bits(tokens.context_histograms(clustered, "cluster", "value"), "cluster")


_SYMBOLS = "(SELECT vec_id, i - 1 AS i, CAST(FLOOR(ABS(embedding[i]::DOUBLE) * 20 + 0.5) AS BIGINT) AS s FROM embeddings, (SELECT range AS i FROM range(1, 33)))"
_LASTS = f"(SELECT a.vec_id, a.i, a.s, MAX(b.i) AS prev FROM {_SYMBOLS} a LEFT JOIN {_SYMBOLS} b ON a.vec_id = b.vec_id AND b.i < a.i AND b.s = a.s GROUP BY ALL)"


@query(f"SELECT l.vec_id, l.i, CASE WHEN l.prev IS NOT NULL THEN COUNT(DISTINCT b.s) FILTER (WHERE b.i > l.prev) ELSE l.s + COUNT(DISTINCT b.s) FILTER (WHERE b.s > l.s) END AS place FROM {_LASTS} l LEFT JOIN {_SYMBOLS} b ON l.vec_id = b.vec_id AND b.i < l.i GROUP BY l.vec_id, l.i, l.s, l.prev", "vec_id:l i:l place:l")
def context_map_places(spark, sf_dir):
    """Symbols of a map as their places in a list to whose front each moves."""
    s = F.transform(F.slice("block", 1, 32), lambda v: F.floor(F.abs(v) * 20 + 0.5).cast("long"))
    rows = _embeddings(spark, sf_dir).select("vec_id", s.alias("s"))
    return rows.select("vec_id", F.posexplode(tokens.move_to_front(F.col("s"))).alias("i", "place"))


@query(f"SELECT vec_id, COUNT(*) AS runs, MAX(n) AS longest, CASE WHEN COUNT(*) * 2 < SUM(n) THEN COUNT(*) * 2 ELSE SUM(n) END AS bytes FROM (SELECT vec_id, g, COUNT(*) AS n FROM (SELECT vec_id, i, SUM(new) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM (SELECT vec_id, i, CASE WHEN s = LAG(s) OVER (PARTITION BY vec_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM {_SYMBOLS})) GROUP BY ALL) GROUP BY vec_id", "vec_id:l runs:l longest:l bytes:l")
def alpha_runs(spark, sf_dir):
    """An opacity row as runs of equal values, or plain, whichever is smaller."""
    s = F.transform(F.slice("block", 1, 32), lambda v: F.floor(F.abs(v) * 20 + 0.5).cast("long"))
    runs = _embeddings(spark, sf_dir).select("vec_id", tokens.zero_runs(s).alias("r"), F.lit(32).alias("plain"))
    return runs.select("vec_id", F.size("r").alias("runs"), F.array_max(F.transform("r", lambda x: x["length"])).alias("longest"), F.least(2 * F.size("r"), F.col("plain")).alias("bytes"))


@query(f"SELECT vec_id, i, s, s + 1 AS t FROM {_SYMBOLS}", "vec_id:l i:l s:l t:l")
def maps_restored(spark, sf_dir):
    """Symbols from their places in the list, and from runs whose values have grown by one."""
    s = F.transform(F.slice("block", 1, 32), lambda v: F.floor(F.abs(v) * 20 + 0.5).cast("long"))
    coded = _embeddings(spark, sf_dir).select("vec_id", tokens.move_to_front(s).alias("places"), F.transform(tokens.zero_runs(s), lambda r: F.struct((r["value"] + 1).alias("value"), r["length"].alias("length"))).alias("runs"))
    both = F.arrays_zip(tokens.from_front(F.col("places"), 64).alias("s"), tokens.from_runs(F.col("runs")).alias("t"))
    return coded.select("vec_id", F.posexplode(both).alias("i", "z")).select("vec_id", "i", "z.*")


# Predictions, quantisation and fields ---------------------------------------------------------------------


@query(f"SELECT vec_id, i, v - CASE WHEN i // 8 < 2 AND i % 8 < 2 THEN ROUND(v * 4) / 4 ELSE 0 END AS residual, v FROM {_DCT}", "vec_id:l i:l residual:d v:d", 5)
def prediction_residuals(spark, sf_dir):
    """Coefficients less a prediction of their lowest ones, and added to it again."""
    cells = _cells(_embeddings(spark, sf_dir).select("vec_id", blocks.dct2d(F.col("block")).alias("block")))
    low = (F.col("i") < 16) & (F.col("i") % 8 < 2)
    guess = F.when(low, F.round(F.col("v") * 4) / 4).otherwise(0.0)
    coded = cells.select("vec_id", "i", (F.col("v") - guess).alias("residual"), guess.alias("guess"))
    return coded.select("vec_id", "i", "residual", (F.col("residual") + F.col("guess")).alias("v"))


@query(f"SELECT image_id, c, y, x, CAST(FLOOR(CASE WHEN high > low THEN (v - low) * 255 / (high - low) ELSE 0 END + 0.5) AS BIGINT) AS guide FROM {MIX} JOIN (SELECT image_id, c, MIN(v) AS low, MAX(v) AS high FROM {MIX} GROUP BY image_id, c) USING (image_id, c)", "image_id:l c:l y:l x:l guide:l")
def guide_image(spark, sf_dir):
    """Planes scaled to bytes by their ends."""
    return grid.normalise(make(spark, sf_dir, "mix"), 255.0).select("image_id", "c", "y", "x", F.floor(F.col("v") + 0.5).cast("long").alias("guide"))


#: Signal from which and up to which a strength falls from the first to the last entry of a table.
SIGMA_LOW, SIGMA_HIGH, SIGMA_TABLE = 0.02, 0.52, [round(40 - 2.5 * i + 0.03 * i * i, 4) for i in range(16)]


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN s <= {SIGMA_LOW} THEN t[1] WHEN s >= {SIGMA_HIGH} THEN t[16] ELSE t[CAST(FLOOR(p) AS BIGINT) + 1] * (1 - (p - FLOOR(p))) + t[LEAST(CAST(FLOOR(p) AS BIGINT) + 2, 16)] * (p - FLOOR(p)) END AS sigma FROM (SELECT l_orderkey, l_linenumber, l_discount * 6 AS s, (l_discount * 6 - {SIGMA_LOW}) * 15 / {SIGMA_HIGH - SIGMA_LOW!r} AS p, {SIGMA_TABLE} AS t FROM lineitem)", "l_orderkey:l l_linenumber:l sigma:d", 5)
def sigma_from_step(spark, sf_dir):
    """Strength of a filter from a quantisation step, between the entries of a table of 16."""
    s = F.col("l_discount") * 6
    p = (s - SIGMA_LOW) * 15 / (SIGMA_HIGH - SIGMA_LOW)
    at = lambda i: F.element_at(F.array(*map(F.lit, SIGMA_TABLE)), F.greatest(F.lit(1), F.least(i + 1, F.lit(16))).cast("int"))
    mixed = at(F.floor(p)) * (1 - (p - F.floor(p))) + at(F.floor(p) + 1) * (p - F.floor(p))
    sigma = F.when(s <= SIGMA_LOW, SIGMA_TABLE[0]).when(s >= SIGMA_HIGH, SIGMA_TABLE[-1]).otherwise(mixed)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sigma.alias("sigma"))


def _bands(first: float, *steps: float) -> list[float]:
    out = [first]
    for v in steps:
        out.append(out[-1] * (1 + v if v > 0 else 1 / (1 - v)))
    return out


_WEIGHTS = _bands(90.0, -0.5, -1.0, -0.25, -0.7, -0.2)


def _weight_sql() -> str:
    pos = f"(SQRT((i % 8) * (i % 8) + (i // 8) * (i // 8)) / 7.0 * {len(_WEIGHTS) - 1} / {math.sqrt(2) + 1e-6!r})"
    a, b = f"{_WEIGHTS}[CAST(FLOOR({pos}) AS BIGINT) + 1]", f"{_WEIGHTS}[CAST(FLOOR({pos}) AS BIGINT) + 2]"
    return f"{a} * POW({b} / {a}, {pos} - FLOOR({pos}))"


@query(f"SELECT range AS i, w, 1 / w AS step FROM (SELECT range, {_weight_sql().replace('i %', 'range %').replace('i //', 'range //')} AS w FROM range(64))", "i:l w:d step:d")
def weight_table(spark, sf_dir):
    """Weights of an 8 x 8 transform from bands of distance, between which they change by equal ratios."""
    i = F.col("id")
    pos = F.sqrt((i % 8) * (i % 8) + F.floor(i / 8) * F.floor(i / 8)) / 7.0 * (len(_WEIGHTS) - 1) / (math.sqrt(2) + 1e-6)
    at = lambda k: F.element_at(F.array(*map(F.lit, _WEIGHTS)), (F.floor(pos) + 1 + k).cast("int"))
    w = at(0) * F.pow(at(1) / at(0), pos - F.floor(pos))
    return spark.range(64).select(i.alias("i"), w.alias("w"), (1 / w).alias("step"))


@query(f"SELECT vec_id, i, CAST(SIGN(v) * FLOOR(ABS(v) * w + 0.5) AS BIGINT) AS q, CAST(SIGN(v) * FLOOR(ABS(v) * w + 0.5) AS BIGINT) / w AS v FROM (SELECT vec_id, i, v, {_weight_sql()} AS w FROM {_DCT})", "vec_id:l i:l q:l v:d", 4)
def weighted_quantisation(spark, sf_dir):
    """Coefficients quantised by a table of weights, and what they stand for."""
    cells = _cells(_embeddings(spark, sf_dir).select("vec_id", blocks.dct2d(F.col("block")).alias("block")))
    weighted = cells.join(F.broadcast(weight_table(spark, sf_dir).select("i", "w")), "i")  # 64 rows
    q = (F.signum("v") * F.floor(F.abs("v") * F.col("w") + 0.5)).cast("long")
    return weighted.select("vec_id", "i", q.alias("q"), (q / F.col("w")).alias("v"))


@query("SELECT o_orderkey, printf('%08x', CAST(FLOOR(o_totalprice) AS BIGINT)) || printf('%04x', o_custkey % 65536) AS packed, CAST(FLOOR(o_totalprice) AS BIGINT) AS scale, o_custkey % 65536 AS dc FROM orders", "o_orderkey:l packed:s scale:l dc:l")
def quantiser_bytes(spark, sf_dir):
    """A quantiser's scale and mean step as six bytes, and read back."""
    scale, dc = F.floor("o_totalprice").cast("long"), F.col("o_custkey") % 65536
    packed = F.lower(F.concat(F.lpad(F.hex(scale), 8, "0"), F.lpad(F.hex(dc), 4, "0")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", packed.alias("packed"))
    part = lambda a, n: F.conv(F.substring("packed", a, n), 16, 10).cast("long")
    return rows.select("o_orderkey", "packed", part(1, 8).alias("scale"), part(9, 4).alias("dc"))


_TILE = f"(SELECT image_id, c, y // 8 AS ty, x // 8 AS tx, x % 8 - 3.5 AS dx, y % 8 - 3.5 AS dy, v FROM {MIX})"


@query(f"SELECT image_id, c, ty, tx, AVG(v) AS base, SUM(v * dx) / SUM(dx * dx) AS gx, SUM(v * dy) / SUM(dy * dy) AS gy FROM {_TILE} GROUP BY ALL", "image_id:l c:l ty:l tx:l base:d gx:d gy:d")
def gradient_planes(spark, sf_dir):
    """The plane of least squares of every tile; over a whole tile its two slopes are independent."""
    return _planes(spark, sf_dir)


def _planes(spark, sf_dir) -> DataFrame:
    at = lambda a: (F.col(a) % 8 - 3.5)
    tiles = make(spark, sf_dir, "mix").select("image_id", "c", F.floor(F.col("y") / 8).alias("ty"), F.floor(F.col("x") / 8).alias("tx"), at("x").alias("dx"), at("y").alias("dy"), "v")
    slope = lambda d: F.sum(F.col("v") * F.col(d)) / F.sum(F.col(d) * F.col(d))
    return tiles.groupBy("image_id", "c", "ty", "tx").agg(F.avg("v").alias("base"), slope("dx").alias("gx"), slope("dy").alias("gy"))


@query(f"SELECT m.image_id, m.c, m.y, m.x, CASE WHEN (ty + tx) % 2 = 0 THEN base + gx * (m.x % 8 - 3.5) + gy * (m.y % 8 - 3.5) ELSE m.v END AS v FROM {MIX} m JOIN (SELECT image_id, c, ty, tx, AVG(v) AS base, SUM(v * dx) / SUM(dx * dx) AS gx, SUM(v * dy) / SUM(dy * dy) AS gy FROM {_TILE} GROUP BY ALL) p ON p.image_id = m.image_id AND p.c = m.c AND p.ty = m.y // 8 AND p.tx = m.x // 8", "image_id:l c:l y:l x:l v:d")
def gradient_applied(spark, sf_dir):
    """Flagged tiles replaced by their planes."""
    cells = make(spark, sf_dir, "mix").withColumn("ty", F.floor(F.col("y") / 8)).withColumn("tx", F.floor(F.col("x") / 8))
    plane = F.col("base") + F.col("gx") * (F.col("x") % 8 - 3.5) + F.col("gy") * (F.col("y") % 8 - 3.5)
    return cells.join(_planes(spark, sf_dir), ["image_id", "c", "ty", "tx"]).select("image_id", "c", "y", "x", F.when((F.col("ty") + F.col("tx")) % 2 == 0, plane).otherwise(F.col("v")).alias("v"))


@query(f"SELECT image_id, y // 8 AS ty, x // 8 AS tx, AVG(COALESCE(ABS(v - nx), 0)) AS hf FROM (SELECT *, LEAD(v) OVER (PARTITION BY image_id, y, x // 8 ORDER BY x) AS nx FROM {MIX} WHERE c = 1) GROUP BY ALL", "image_id:l ty:l tx:l hf:d")
def high_frequency(spark, sf_dir):
    """Mean absolute difference to the next cell, by tile."""
    w = Window.partitionBy("image_id", "y", F.floor(F.col("x") / 8)).orderBy("x")
    gap = F.coalesce(F.abs(F.col("v") - F.lead("v").over(w)), F.lit(0.0))
    return make(spark, sf_dir, "mix").where("c = 1").withColumn("gap", gap).groupBy("image_id", F.floor(F.col("y") / 8).alias("ty"), F.floor(F.col("x") / 8).alias("tx")).agg(F.avg("gap").alias("hf"))


@query(f"SELECT vec_id, SUM(CASE WHEN i > 0 THEN v * v * (i // 8 + i % 8) ELSE 0 END) / SUM(v * v) AS energy FROM {_DCT} GROUP BY vec_id", "vec_id:l energy:d", 5)
def transform_energy(spark, sf_dir):
    """How far up the frequencies a block's energy lies."""
    cells = _cells(_embeddings(spark, sf_dir).select("vec_id", blocks.dct2d(F.col("block")).alias("block")))
    return cells.groupBy("vec_id").agg((F.sum(F.when(F.col("i") > 0, F.col("v") * F.col("v") * (F.floor(F.col("i") / 8) + F.col("i") % 8)).otherwise(0.0)) / F.sum(F.col("v") * F.col("v"))).alias("energy"))


@query(f"SELECT image_id, y, x, x_res, b_res FROM (SELECT image_id, y, x, r - COALESCE(LAG(r) OVER w, 0) - FLOOR((g - COALESCE(LAG(g) OVER w, 0)) / 2) AS x_res, b - COALESCE(LAG(b) OVER w, 0) - (g - COALESCE(LAG(g) OVER w, 0)) AS b_res FROM {_RGB} WINDOW w AS (PARTITION BY image_id, y ORDER BY x))", "image_id:l y:l x:l x_res:l b_res:l")
def chroma_residuals(spark, sf_dir):
    """Steps of two planes along a row, less what the luminance's step says of them."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))
    rows = _rgb(spark, sf_dir).select("image_id", "y", "x", step("r").alias("dr"), step("g").alias("dg"), step("b").alias("db"))
    return rows.select("image_id", "y", "x", (F.col("dr") - F.floor(F.col("dg") / 2)).cast("long").alias("x_res"), (F.col("db") - F.col("dg")).cast("long").alias("b_res"))


@query(f"SELECT image_id, y, x, r, b FROM {_RGB}", "image_id:l y:l x:l r:l b:l")
def chroma_restored(spark, sf_dir):
    """Both planes from their residuals and the luminance, by running sums along each row."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    g = _rgb(spark, sf_dir).select("image_id", "y", "x", (F.col("g") - F.coalesce(F.lag("g").over(w), F.lit(0.0))).alias("dg"))
    both = chroma_residuals(spark, sf_dir).join(g, ["image_id", "y", "x"])
    return both.select("image_id", "y", "x", F.sum(F.col("x_res") + F.floor(F.col("dg") / 2)).over(w).cast("long").alias("r"), F.sum(F.col("b_res") + F.col("dg")).over(w).cast("long").alias("b"))


_METHODS = {"plain": ("r", "g", "b"), "less_green": ("r - g", "g", "b - g"), "less_red": ("r", "g - r", "b - r"), "mean": ("r - b", "g - FLOOR((r + b) / 2)", "b")}
_METHOD_SQL = " UNION ALL ".join(f"SELECT image_id, '{name}' AS method, SUM(" + " + ".join(f"ABS({p})" for p in parts) + f") AS cost FROM {_RGB} GROUP BY image_id" for name, parts in _METHODS.items())


@query(_METHOD_SQL, "image_id:l method:s cost:d")
def plane_methods(spark, sf_dir):
    """Absolute sums of the planes under several ways of taking one off another."""
    costs = [F.sum(sum((F.abs(F.expr(p)) for p in parts[1:]), F.abs(F.expr(parts[0])))).alias(name) for name, parts in _METHODS.items()]
    return _rgb(spark, sf_dir).groupBy("image_id").agg(*costs).select("image_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, _METHODS)), F.array(*_METHODS))).alias("method", "cost"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b FROM {_CELLS} a JOIN {_CELLS} b ON a.vec_id // 16 = b.vec_id // 16 AND a.vec_id < b.vec_id AND a.i = b.i GROUP BY a.vec_id, b.vec_id HAVING SUM((a.v - b.v) * (a.v - b.v)) < 1.4", "a:l b:l")
def similar_blocks(spark, sf_dir):
    """Pairs of blocks of one neighbourhood of 16 whose squared distance is small."""
    rows = _embeddings(spark, sf_dir).withColumn("cell", F.floor(F.col("vec_id") / 16))
    other = rows.select("cell", F.col("vec_id").alias("b"), F.col("block").alias("other"))
    distance = F.aggregate(F.zip_with("block", "other", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return rows.join(other, "cell").where(F.col("vec_id") < F.col("b")).where(distance < 1.4).select(F.col("vec_id").alias("a"), "b")


# Noise ----------------------------------------------------------------------------------------------------

#: Two rounds of a linear congruence turn a cell's number into a uniform one: the same in every engine and on every retry.
_UNIFORM = "((({k} * 1103515245 + {seed}) % 2147483648 * 1103515245 + 12345) % 2147483648 + 0.5) / 2147483648"


def _uniform(k, seed: int):
    step = lambda x, add: (x * 1103515245 + add) % 2147483648
    return (step(step(k, seed), 12345) + 0.5) / 2147483648.0


_U, _V = _UNIFORM.format(k="event_id", seed=17), _UNIFORM.format(k="event_id", seed=4242)


@query(f"SELECT event_id, CASE WHEN u < 0.05 THEN 0 WHEN u >= 0.95 THEN 255 ELSE value END AS impulse, value + (u - 0.5) * 8 AS uniform, value + SQRT(-2 * LN(u)) * COS(2 * PI() * w) * 3 AS gaussian FROM (SELECT event_id, value, {_U} AS u, {_V} AS w FROM events)", "event_id:l impulse:d uniform:d gaussian:d", 4)
def noise_distributions(spark, sf_dir):
    """Salt and pepper, uniform and normal noise on a column, drawn from the row's number."""
    k = F.col("event_id").cast("long")
    u, w = _uniform(k, 17), _uniform(k, 4242)
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(u < 0.05, 0.0).when(u >= 0.95, 255.0).otherwise(F.col("value")).alias("impulse"), (F.col("value") + (u - 0.5) * 8).alias("uniform"), (F.col("value") + F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w) * 3).alias("gaussian")
    )


@query(f"SELECT event_id, COUNT(*) FILTER (WHERE acc <= u) AS drawn FROM (SELECT event_id, u, SUM(p) OVER (PARTITION BY event_id ORDER BY j) AS acc FROM (SELECT event_id, {_U} AS u, range AS j, EXP(-4.0 + range * LN(4.0) - lgamma(range + 1)) AS p FROM events, range(0, 40))) GROUP BY event_id", "event_id:l drawn:l")
def noise_poisson(spark, sf_dir):
    """Counts with a mean of 4: how many steps of their distribution lie below a uniform number."""
    steps, total, p = [], 0.0, math.exp(-4.0)
    for j in range(40):
        total += p
        steps.append(total)
        p *= 4.0 / (j + 1)
    u = _uniform(F.col("event_id").cast("long"), 17)
    return table(spark, sf_dir, "events").select("event_id", lanes.let(u, lambda x: F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= x))).alias("drawn"))


# Counters -------------------------------------------------------------------------------------------------


@query("SELECT run, layer, n, size, size / SUM(size) OVER (PARTITION BY run) AS share FROM (SELECT l_returnflag AS run, l_linestatus AS layer, COUNT(*) AS n, SUM(l_quantity) AS size FROM lineitem GROUP BY ALL)", "run:s layer:s n:l size:d share:d")
def layer_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("layer"), "l_quantity")
    return summary.layer_sizes(rows, "layer", "l_quantity", ["run"])


@query("SELECT COUNT(*) AS images, SUM(l_quantity) AS bytes, SUM(l_linenumber) AS blocks, SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS filtered FROM lineitem", "images:l bytes:d blocks:l filtered:l", 2)
def run_counters(spark, sf_dir):
    return summary.counters(table(spark, sf_dir, "lineitem"), [], images=F.lit(1), bytes=F.col("l_quantity"), blocks=F.col("l_linenumber"), filtered=(F.col("l_discount") > 0.05).cast("int"))


@query(f"SELECT i % 8 AS k, COUNT(*) AS n, SUM(CASE WHEN ROUND(v * 4) / 4 - v < -0.05 THEN 1 ELSE 0 END) AS low, SUM(CASE WHEN ROUND(v * 4) / 4 - v > 0.05 THEN 1 ELSE 0 END) AS high FROM {_CELLS} GROUP BY ALL", "k:l n:l low:l high:l")
def clamp_counts(spark, sf_dir):
    cells = _cells(_embeddings(spark, sf_dir)).withColumn("k", F.col("i") % 8)
    return summary.clamp_counts(cells, F.col("v"), F.round(F.col("v") * 4) / 4, F.lit(0.1), ["k"])


@query("SELECT l_returnflag, SUM(ABS(l_tax)) AS before, SUM(ABS(l_tax - 0.5 * l_discount)) AS after, SUM(l_tax * l_tax) AS xx, SUM(l_discount * l_discount) AS yy, SUM(l_tax * l_discount) AS xy FROM lineitem GROUP BY 1", "l_returnflag:s before:d after:d xx:d yy:d xy:d", 3)
def correlation_counters(spark, sf_dir):
    return summary.correlation_sums(table(spark, sf_dir, "lineitem"), F.col("l_tax"), F.col("l_discount"), F.lit(0.5), ["l_returnflag"])


@query("WITH o AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax + 0.01 AS x, l_discount + 0.01 AS y, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1e9 + l_extendedprice) AS i FROM lineitem) SELECT a.l_orderkey, a.i, SUM(b.x * b.y * POW(0.9, a.i - b.i)) / SUM(b.y * b.y * POW(0.9, a.i - b.i)) AS slope FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.i <= a.i GROUP BY ALL", "l_orderkey:l i:l slope:d")
def forgetting_slope(spark, sf_dir):
    """A slope that forgets: older lines of an order weigh less and less."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1e9 + F.col("l_extendedprice")).alias("at"), (F.col("l_tax") + 0.01).alias("x"), (F.col("l_discount") + 0.01).alias("y"))
    placed = rows.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("at")))
    return summary.forgetting_slope(placed, "x", "y", "at", ["l_orderkey"]).select("l_orderkey", "i", "slope")


@query(
    "WITH r AS (SELECT l_orderkey AS k, l_extendedprice AS s, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1e9 + l_extendedprice) AS i FROM lineitem), m AS (SELECT k, MEDIAN(s) AS med FROM r GROUP BY k), d AS (SELECT k, MEDIAN(ABS(s - med)) AS mad FROM r JOIN m USING (k) GROUP BY k), f AS (SELECT k, COUNT(*) AS n, MAX(s) FILTER (WHERE i = 1) AS a, MAX(s) FILTER (WHERE i = 2) AS b, EXP(AVG(LN(s)) FILTER (WHERE i > 1)) AS g FROM r GROUP BY k) SELECT k, n, CASE WHEN n = 1 THEN a WHEN n = 2 THEN b WHEN n <= 5 THEN g ELSE med END AS seconds, CASE WHEN n > 5 THEN mad ELSE 0 END AS spread FROM f JOIN m USING (k) JOIN d USING (k)",
    "k:l n:l seconds:d spread:d", 4,
)
def elapsed_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1e9 + F.col("l_extendedprice")).alias("at"), F.col("l_extendedprice").alias("s"))
    return summary.elapsed_summary(rows, "k", "at", "s")


@query("SELECT event_type, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY 1", "event_type:s iqr:d")
def quartile_range(spark, sf_dir):
    return summary.quartile_range(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("SELECT SUM(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS bad, COUNT(*) AS n FROM events", "bad:l n:l")
def not_numbers(spark, sf_dir):
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return summary.not_numbers(table(spark, sf_dir, "events"), v)


@query("SELECT label, CASE WHEN label % 3 = 0 OR MAX(ABS(embedding[1] - embedding[2])) < 0.01 THEN 1 ELSE 0 END AS gray, CASE WHEN label % 2 = 0 OR MIN(embedding[4]) < -0.3 THEN 1 ELSE 0 END AS alpha FROM embeddings GROUP BY label", "label:l gray:l alpha:l")
def palette_kinds(spark, sf_dir):
    """Whether a palette is gray throughout, or one of its entries is not opaque."""
    e = lambda i: F.get("embedding", F.lit(i))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(((F.col("label") % 3 == 0) | (F.max(F.abs(e(0) - e(1))) < 0.01)).cast("int").alias("gray"), ((F.col("label") % 2 == 0) | (F.min(e(3)) < -0.3)).cast("int").alias("alpha"))


@query("SELECT l_orderkey, l_linenumber, l_partkey // 8 AS bx, l_suppkey // 8 AS by, (l_partkey + l_quantity::BIGINT + 7) // 8 - l_partkey // 8 AS bw, (l_suppkey + l_linenumber + 7) // 8 - l_suppkey // 8 AS bh FROM lineitem", "l_orderkey:l l_linenumber:l bx:l by:l bw:l bh:l")
def block_rects(spark, sf_dir):
    """The blocks of 8 that a rectangle of cells touches."""
    first = lambda a: F.floor(F.col(a) / 8)
    upto = lambda a, n: F.floor((F.col(a) + F.col(n).cast("long") + 7) / 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", first("l_partkey").alias("bx"), first("l_suppkey").alias("by"), (upto("l_partkey", "l_quantity") - first("l_partkey")).alias("bw"), (upto("l_suppkey", "l_linenumber") - first("l_suppkey")).alias("bh"))


@query("SELECT p_size AS downsampling, COUNT(*) FILTER (WHERE shift >= p_size) AS passes FROM (SELECT DISTINCT p_size FROM part), (VALUES (8), (4), (2), (1)) s(shift) GROUP BY p_size", "downsampling:l passes:l")
def passes_for_downsampling(spark, sf_dir):
    """How many passes a reader of a smaller image needs: those whose own downsampling is not finer."""
    passes = spark.range(4).select(F.pow(F.lit(2), 3 - F.col("id")).alias("shift"))
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("downsampling")).distinct()
    return sizes.crossJoin(F.broadcast(passes)).groupBy("downsampling").agg(F.count_if(F.col("shift") >= F.col("downsampling")).alias("passes"))  # four rows
