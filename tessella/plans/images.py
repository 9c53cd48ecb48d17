"""Queries on image files made of all embeddings, differences along lines, coefficients of blocks of several sizes, and closed loops."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import color, names
from tessella.operators import blocks, clusters, coefficients, colorspace, factormaps, fits, lines, lowfreq, patches, perceptual, predict, quanttables, search, stencil, tokens, transforms
from tessella.plans.codec import _BIG, _CONTEXT, _ORDER, _TOKENS, _bands, _basis_sql, _mosaic, _tokens
from tessella.plans.grids import _BASIS, _CELLS, _DCT, _RGB, CELL, DOTS, H, MIX, MIX_B, W, _embeddings, _rgb, make, size
from tessella.plans.sql import plain, typed
from tessella.plans.tables import CLUSTER_ROUNDS, TABLE_BITS, clusters_sql
from tessella.sources import chunks, images, spans
from tessella.storage import materialize, new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, columns: str = CELL, places: int = 6):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir), places)
        if sql:
            SQL[f.__name__] = typed(sql, columns, places)
        return f

    return register


# Chunks of PNG files --------------------------------------------------------------------------------------
# Each embedding is an 8 x 8 image. Its number says how many planes it has and which chunks tell of its colour.

_PLANES = "CASE vec_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 3 END"
_MILLI = "CAST(FLOOR(ABS(embedding[{}]::DOUBLE) * 1000) AS BIGINT)"
#: Chromaticities that are named, and some that are not.
_WHITES, _PRIMARIES = ("D65", "D60", "D50"), ("SRG", "202", "AP1")


def _planes():
    return F.element_at(F.array(*map(F.lit, (1, 3, 2, 4, 3))), (F.col("vec_id") % 5 + 1).cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of one file per embedding, written to the shared folder and read again."""
    k = lambda e: F.floor(F.abs(e) * 1000)
    rows = _embeddings(spark, sf_dir).select("vec_id", "block", F.explode(F.sequence(F.lit(0), _planes() - 1)).alias("c"), _planes().alias("planes"))
    rows = rows.select("vec_id", "block", "c", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    row = F.transform(F.slice("block", F.col("y") * 8 + 1, F.lit(8)), lambda v: (k(v) + F.col("c") * 50) % 256)
    rows = rows.select(F.format_string("%d.png", "vec_id").alias("path"), F.lit(8).alias("bits"), "c", "y", row.cast("array<double>").alias("row"))
    told = _embeddings(spark, sf_dir).select("vec_id", F.format_string("%d.png", "vec_id").alias("path"), k(F.col("block")[0]).alias("first"), k(F.col("block")[1]).alias("second"))
    blobs = images.encode(rows, "png").join(told, "path")
    i = F.col("vec_id")
    pick = lambda by, values: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    gamma = F.when(i % 4 == 1, F.lit(0.45455)).when(i % 4 == 2, (F.col("first") % 900 + 50) / 1000).when(i % 4 == 3, F.lit(1.0))
    xy = [pick(F.floor(i / 3), [names.WHITE_POINTS[n][k] for n in _WHITES]) for k in range(2)] + [pick(F.floor(i / 7), [names.PRIMARIES[n][k] for n in _PRIMARIES]) for k in range(6)]
    added = [
        F.when(i % 11 == 3, chunks.intent_chunk(F.floor(i / 11) % 4)),
        F.when(gamma.isNotNull(), chunks.gamma_chunk(gamma)),
        F.when(i % 3 == 0, chunks.chromaticity_chunk(xy)),
        F.when(i % 13 == 5, chunks.chunk("iCCP", F.encode(F.concat(F.lit(chunks.PQ_PROFILE + "\0\0"), F.lit("x")), "ISO-8859-1"))),
        F.when((i % 5 == 1) & (i % 2 == 0), chunks.chunk("tRNS", F.unhex(F.lit("000100020003")))),
        chunks.text_chunk("Comment", F.format_string("vector %d begins with %d", i, "first")),
        F.when(i % 6 == 0, chunks.text_chunk("Title", F.format_string("%d", "second"))),
    ]
    whole = chunks.add_chunks(blobs, added)
    # every 17th file has a changed byte in its first added chunk's data, and every 19th breaks off in the middle
    hurt = F.when(i % 17 == 4, F.concat(F.substring("content", 1, chunks.HEAD_BYTES + 8), F.lit(b"\xee"), F.substring("content", F.lit(chunks.HEAD_BYTES + 10), F.octet_length("content"))))
    hurt = hurt.when(i % 19 == 7, F.substring("content", F.lit(1), F.octet_length("content") - 30)).otherwise(F.col("content"))
    folder = new_folder(spark, "png")
    images.write_files(whole.select("path", hurt.alias("content")), folder)
    return images.files(spark, folder, "*.png", tasks=4 * spark.sparkContext.defaultParallelism)


def _vec():
    return F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long").alias("vec_id")


_WHITE_SQL = f"CASE WHEN vec_id % 3 = 0 THEN {list(_WHITES)!r}[vec_id // 3 % 3 + 1] ELSE 'D65' END"
_PRIMARIES_SQL = f"CASE WHEN vec_id % 3 = 0 THEN {list(_PRIMARIES)!r}[vec_id // 7 % 3 + 1] ELSE 'SRG' END"
_GAMMA_SQL = f"CASE vec_id % 4 WHEN 1 THEN 0.45455 WHEN 2 THEN ({_MILLI.format(1)} % 900 + 50) / 1000.0 WHEN 3 THEN 1.0 END"
_TRANSFER_SQL = f"CASE WHEN g IS NULL OR ABS(g - {1 / 2.2!r}) < 0.001 THEN 'SRG' WHEN ABS(g - 1) < 0.001 THEN 'Lin' WHEN ABS(g - {256 / 563!r}) < 0.001 THEN 'Ado' ELSE printf('g%.7f', g) END"
_HURT = "vec_id % 17 = 4 OR vec_id % 19 = 7"


@query(
    f"""WITH f AS (SELECT vec_id, {_PLANES} AS planes, {_WHITE_SQL} AS white, {_PRIMARIES_SQL} AS prim, CAST({_GAMMA_SQL} AS DOUBLE) AS g FROM embeddings WHERE NOT ({_HURT}))
SELECT vec_id, 8 AS width, 8 AS height, 8 AS depth, CAST(planes < 3 AS BIGINT) AS gray, CAST(planes % 2 = 0 OR (vec_id % 5 = 1 AND vec_id % 2 = 0) AS BIGINT) AS alpha, g AS gamma,
CASE WHEN planes < 3 THEN 'Gra_' ELSE 'RGB_' END || CASE WHEN vec_id % 13 = 5 THEN 'D65' WHEN vec_id % 11 = 3 THEN 'D65' ELSE white END || '_' || CASE WHEN planes < 3 THEN '' WHEN vec_id % 13 = 5 THEN '202_' WHEN vec_id % 11 = 3 THEN 'SRG_' ELSE prim || '_' END
|| CASE WHEN vec_id % 13 = 5 THEN 'Rel_PeQ' WHEN vec_id % 11 = 3 THEN ['Per', 'Rel', 'Sat', 'Abs'][vec_id // 11 % 4 + 1] || '_SRG' ELSE 'Per_' || {_TRANSFER_SQL} END AS encoding FROM f""",
    "vec_id:l width:l height:l depth:l gray:l alpha:l gamma:d encoding:s",
)
def png_properties(spark, sf_dir):
    """What the chunks of intact files say of size, gray, transparency, gamma and colour encoding."""
    found = materialize(chunks.chunks(_files(spark, sf_dir)), "chunks")  # read twice, walked once
    kept = chunks.properties(found.join(chunks.refused(found).select("path"), "path", "left_anti"))
    return kept.select(_vec(), "width", "height", "depth", F.col("gray").cast("long").alias("gray"), F.col("alpha").cast("long").alias("alpha"), "gamma", "encoding")


@query(f"SELECT vec_id, 'Comment' AS keyword, printf('vector %d begins with %d', vec_id, {_MILLI.format(1)}) AS text FROM embeddings WHERE NOT ({_HURT}) UNION ALL SELECT vec_id, 'Title', printf('%d', {_MILLI.format(2)}) FROM embeddings WHERE vec_id % 6 = 0 AND NOT ({_HURT})", "vec_id:l keyword:s text:s")
def png_texts(spark, sf_dir):
    """All texts of intact files."""
    found = materialize(chunks.chunks(_files(spark, sf_dir)), "chunks")  # read twice, walked once
    return chunks.texts(found.join(chunks.refused(found).select("path"), "path", "left_anti")).select(_vec(), "keyword", "text")


@query(f"""SELECT vec_id, CASE WHEN vec_id % 17 = 4 THEN 'checksum differs' ELSE 'cut off' END AS problem,
CASE WHEN vec_id % 17 <> 4 THEN 'IDAT' WHEN vec_id % 11 = 3 THEN 'sRGB' WHEN vec_id % 4 > 0 THEN 'gAMA' WHEN vec_id % 3 = 0 THEN 'cHRM' WHEN vec_id % 13 = 5 THEN 'iCCP' WHEN vec_id % 5 = 1 AND vec_id % 2 = 0 THEN 'tRNS' ELSE 'tEXt' END AS kind FROM embeddings WHERE {_HURT}""", "vec_id:l problem:s kind:s")
def png_refused(spark, sf_dir):
    """Files with a damaged checksum or a missing end, and the chunk that is to blame."""
    return chunks.refused(chunks.chunks(_files(spark, sf_dir))).select(_vec(), "problem", "kind")


# Lines ------------------------------------------------------------------------------------------------------

_ABOVE, _BELOW, _NORM = 1.1, 0.9, 70.0
_LINES = ", ".join(f"({k}, {dx}, {dy})" for k, line in enumerate(lines.directions()) for dx, dy in line)
_PART = lambda share, w: f"{lines.FACTOR * (share * w) ** 0.5 / (2 * lines.HALF_LENGTH + 1)!r} * {_NORM} / ({_NORM} + 0.5 * (ABS(a) + ABS(b)))"


@query(
    f"""WITH g AS (SELECT image_id, c, y, x, a.v - 128 AS a, b.v - 128 AS b FROM {MIX} a JOIN {MIX_B} b USING (image_id, c, y, x)),
d AS (SELECT image_id, c, y, x, {_PART(lines.WEIGHT, _ABOVE)} * (a - b) + CASE WHEN a < b THEN -1 ELSE 1 END * {_PART(lines.SURCHARGE, _BELOW)} * GREATEST({lines.LEAST_SHARE} * ABS(a) - seen, seen - {lines.LARGEST_SHARE} * ABS(a), 0) AS d FROM (SELECT *, CASE WHEN a < 0 THEN -b ELSE b END AS seen FROM g)),
s AS (SELECT image_id, c, y - dy AS y, x - dx AS x, line, SUM(d) AS s FROM d, (VALUES {_LINES}) t(line, dx, dy) GROUP BY ALL)
SELECT image_id, c, y, x, SUM(s * s) AS v FROM s WHERE x >= 0 AND y >= 0 AND x < {W} AND y < {H} GROUP BY ALL""",
    CELL, 5,
)
def line_difference(spark, sf_dir):
    """How two images differ along lines of sixteen directions."""
    a, b = (make(spark, sf_dir, n).withColumn("v", F.col("v") - 128) for n in ("mix", "mix_b"))
    return lines.line_difference(a, b, W, H, _ABOVE, _BELOW, _NORM)


# Distance of images ------------------------------------------------------------------------------------------

_SIGMAS = (3.2, 1.6)


def _blur_ctes(name: str, source: str, sigma: float) -> str:
    """CTEs that end in `name`: the blur of `source` along rows, then along columns, weights normalised at the borders."""
    radius = max(1, math.ceil(2.25 * sigma))
    taps = ", ".join(f"({k - radius}, {w!r}::DOUBLE)" for k, w in enumerate(stencil.gaussian(radius, sigma)))
    along = lambda of, at, n: f"SELECT image_id, c, {'y, x + d AS x' if at == 'x' else 'y + d AS y, x'}, SUM(w * v) / SUM(w) AS v FROM {of}, (VALUES {taps}) k(d, w) WHERE {at} + d >= 0 AND {at} + d < {n} GROUP BY ALL"
    return f"{name}_x AS MATERIALIZED ({along(source, 'x', W)}), {name} AS MATERIALIZED ({along(name + '_x', 'y', H)})"


_GAPS = ", ".join(f"ABS(v - {f}(v) OVER (PARTITION BY image_id, c, {a} ORDER BY {b}))" for f in ("LAG", "LEAD") for a, b in (("y", "x"), ("x", "y")))
_DISTANCE = f"""WITH r0 AS MATERIALIZED (SELECT image_id, c, y, x, v FROM {MIX} UNION ALL SELECT image_id, c + 10, y, x, v FROM {MIX_B}),
{_blur_ctes('l0', 'r0', _SIGMAS[0])}, r1 AS MATERIALIZED (SELECT image_id, c, y, x, r.v - l.v AS v FROM r0 r JOIN l0 l USING (image_id, c, y, x)),
{_blur_ctes('l1', 'r1', _SIGMAS[1])}, r2 AS (SELECT image_id, c, y, x, r.v - l.v AS v FROM r1 r JOIN l1 l USING (image_id, c, y, x)),
n AS MATERIALIZED (SELECT p.band, p.image_id, p.c, p.y, p.x, p.v AS a, q.v AS b FROM (SELECT 0 AS band, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM r2) p JOIN (SELECT 0 AS band, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM r2) q ON q.band = p.band AND q.image_id = p.image_id AND q.c = p.c + 10 AND q.y = p.y AND q.x = p.x),
d AS (SELECT band, image_id, c, y, x, {_PART(lines.WEIGHT, _ABOVE)} * (a - b) + CASE WHEN a < b THEN -1 ELSE 1 END * {_PART(lines.SURCHARGE, _BELOW)} * GREATEST({lines.LEAST_SHARE} * ABS(a) - seen, seen - {lines.LARGEST_SHARE} * ABS(a), 0) AS d FROM (SELECT *, CASE WHEN a < 0 THEN -b ELSE b END AS seen FROM n WHERE band > 0)),
s AS (SELECT band, image_id, c, y - dy AS y, x - dx AS x, line, SUM(d) AS s FROM d, (VALUES {_LINES}) t(line, dx, dy) GROUP BY ALL),
e AS (SELECT image_id, c, y, x, SUM(w * e) AS e FROM (SELECT band, image_id, c, y, x, SUM(s * s) AS e FROM s WHERE x >= 0 AND y >= 0 AND x < {W} AND y < {H} GROUP BY ALL UNION ALL SELECT band, image_id, c, y, x, (a - b) * (a - b) FROM n WHERE band = 0) JOIN (VALUES {', '.join(f'({k}, {w}::DOUBLE)' for k, w in enumerate(perceptual.BAND_WEIGHTS))}) k(band, w) USING (band) GROUP BY ALL),
gaps AS (SELECT image_id, c, y, x, LEAST(list_avg([{_GAPS}]), 255) AS v FROM r0),
{_blur_ctes('calm', 'gaps', 2.0)},
m AS (SELECT image_id, c % 10 AS c, y, x, 1 / (1 + 0.1 * MIN(v)) AS m FROM calm GROUP BY ALL),
cells AS (SELECT image_id, y, x, CASE WHEN d < 1e-4 THEN 100 * d ELSE SQRT(d) END AS v FROM (SELECT image_id, y, x, SUM(e * m) AS d FROM e JOIN m USING (image_id, c, y, x) GROUP BY ALL))"""


@query(f"{_DISTANCE} SELECT image_id, y, x, v FROM cells", "image_id:l y:l x:l v:d", 5)
def distance_cells(spark, sf_dir):
    """How far apart two images look, cell by cell: blurred bands by squares, fine ones along lines, masked by what is around."""
    return perceptual.line_distance_map(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b"), W, H, _SIGMAS)


@query(f"{_DISTANCE} SELECT image_id, MAX(v) AS score, (" + " + ".join(f"POW(AVG(POW(v, {k})), 1 / {k}.0::DOUBLE)" for k in (3, 6, 12)) + ") / 3 AS norm FROM cells GROUP BY image_id", "image_id:l score:d norm:d", 5)
def image_distance(spark, sf_dir):
    """The distance of two images as one figure: the worst cell, and norms over all cells."""
    return perceptual.line_distance(make(spark, sf_dir, "mix"), make(spark, sf_dir, "mix_b"), W, H, _SIGMAS)


# Factors between planes ----------------------------------------------------------------------------------------

_TILE, _ZERO_STEP = 8, 40.0
_SIGNED = f"(SELECT image_id, c, y, x, v - 128 AS v FROM {MIX})"
_FACTORS = f"""WITH p AS MATERIALIZED (SELECT o.image_id, o.c, o.y // {_TILE} AS ty, o.x // {_TILE} AS tx, CEIL(LEAST((o.v - {_ZERO_STEP} / 2) / m.v, (o.v + {_ZERO_STEP} / 2) / m.v) * 64 + 128) AS first, FLOOR(GREATEST((o.v - {_ZERO_STEP} / 2) / m.v, (o.v + {_ZERO_STEP} / 2) / m.v) * 64 + 128) AS last
FROM {_SIGNED} o JOIN {_SIGNED} m ON o.c <> 1 AND m.c = 1 AND m.image_id = o.image_id AND m.y = o.y AND m.x = o.x AND m.v <> 0),
n AS MATERIALIZED (SELECT image_id, c, ty, tx, f, COUNT(*) AS n FROM p JOIN (SELECT range AS f FROM range(256)) ON f BETWEEN first AND last GROUP BY ALL),
own AS (SELECT image_id, c, ty, tx, ARG_MIN(f, f - n * 1000) AS f, MAX(n) AS n FROM n GROUP BY ALL),
whole AS (SELECT image_id, c, ARG_MIN(f, f - n * 1000) AS f, MAX(n) AS n FROM (SELECT image_id, c, f, SUM(n) AS n FROM n GROUP BY ALL) GROUP BY ALL),
t AS (SELECT DISTINCT image_id, c, y // {_TILE} AS ty, x // {_TILE} AS tx FROM {MIX} WHERE c <> 1),
j AS (SELECT t.*, o.f, COALESCE(o.n, 0) AS n, w.f AS wf, COALESCE(w.n, 0) AS wn, COALESCE(h.n, 0) AS hn, SUM(COALESCE(o.n, 0)) OVER (PARTITION BY t.image_id, t.c) > 1.25 * COALESCE(w.n, 0) AS better FROM t LEFT JOIN own o USING (image_id, c, ty, tx) LEFT JOIN whole w USING (image_id, c) LEFT JOIN n h ON h.image_id = t.image_id AND h.c = t.c AND h.ty = t.ty AND h.tx = t.tx AND h.f = w.f),
found AS MATERIALIZED (SELECT image_id, c, ty, tx, COALESCE(CASE WHEN better THEN f ELSE wf END, 128) AS factor, CASE WHEN better THEN n ELSE hn END AS zeros FROM j)"""


def _signed(spark, sf_dir) -> DataFrame:
    return make(spark, sf_dir, "mix").withColumn("v", F.col("v") - 128)


@query(f"{_FACTORS} SELECT * FROM found", "image_id:l c:l ty:l tx:l factor:l zeros:l")
def factor_maps(spark, sf_dir):
    """The factor of the main plane that quantises most cells of each tile to zero, or of the whole plane if that is nearly as good."""
    return factormaps.best_factors(_signed(spark, sf_dir), _ZERO_STEP, tile=_TILE)


@query(f"""{_FACTORS}, d AS (SELECT image_id, c, ty * 1000 + tx AS k, (factor - COALESCE(LAG(factor) OVER (PARTITION BY image_id, c ORDER BY ty, tx), 128) + 256) % 256 AS d FROM found),
u AS (SELECT image_id, c, k, CASE WHEN d < 128 THEN 2 * d ELSE 511 - 2 * d END AS u FROM d),
r AS (SELECT *, SUM(new) OVER (PARTITION BY image_id, c ORDER BY k) AS run FROM (SELECT *, CASE WHEN u = LAG(u) OVER (PARTITION BY image_id, c ORDER BY k) THEN 0 ELSE 1 END AS new FROM u))
SELECT image_id, c, {W // _TILE} AS across, string_agg(printf('%02x%02x', n - 1, u), '' ORDER BY run) AS code FROM (SELECT image_id, c, run, u, COUNT(*) AS n FROM r GROUP BY ALL) GROUP BY image_id, c""", "image_id:l c:l across:l code:s")
def factor_map_codes(spark, sf_dir):
    """Those maps as they are written."""
    return factormaps.map_bytes(factormaps.best_factors(_signed(spark, sf_dir), _ZERO_STEP, tile=_TILE))


@query(f"{_FACTORS} SELECT o.image_id, o.c, o.y, o.x, o.v - COALESCE((factor - 128) / 64.0::DOUBLE * m.v, 0) AS v FROM {_SIGNED} o LEFT JOIN found f ON f.image_id = o.image_id AND f.c = o.c AND f.ty = o.y // {_TILE} AND f.tx = o.x // {_TILE} LEFT JOIN {_SIGNED} m ON m.c = 1 AND m.image_id = o.image_id AND m.y = o.y AND m.x = o.x")
def planes_less_main(spark, sf_dir):
    """Planes less what their written and read maps predict from the main one."""
    cells = _signed(spark, sf_dir)
    read = factormaps.read_map(factormaps.map_bytes(factormaps.best_factors(cells, _ZERO_STEP, tile=_TILE)))
    return factormaps.apply_map(cells, read, -1, tile=_TILE)


# Colours of described encodings ----------------------------------------------------------------------------
# The source of a cell goes by its image and row, its target by its column.

_SOURCES = ("RGB_D65_SRG_Rel_SRG", "RGB_D65_202_Per_PeQ", "RGB_D50_Ado_Rel_g0.4547069", "RGB_EER_DCI_Abs_Lin", "RGB_D60_AP0_Rel_HLG")
_TARGETS = ("RGB_D65_202_Rel_HLG", "RGB_D60_AP1_Rel_PeQ", "RGB_D50_AP1_Abs_Lin", "Gra_D50_Rel_g0.5", "RGB_EER_SRG_Sat_SRG", "RGB_D65_Ado_Per_g0.4547069")
_CONES = np.array(colorspace.BRADFORD)
_white = lambda x, y: np.array([x / y, 1, (1 - x - y) / y])
_D50 = _white(*colorspace.CONNECTION_WHITE)


def _light(name: str, adapted: bool) -> np.ndarray:
    """Linear light of a described space to XYZ."""
    _, white, primaries, *_ = name.split("_")
    six, w = names.PRIMARIES[primaries], _white(*names.WHITE_POINTS[white])
    p = np.array([_white(*six[k : k + 2]) for k in (0, 2, 4)]).T
    own = p * np.linalg.solve(p, w)
    return np.linalg.inv(_CONES) @ np.diag(_CONES @ _D50 / (_CONES @ w)) @ _CONES @ own if adapted else own


def _between(source: str, target: str) -> np.ndarray:
    adapted = "_Abs_" not in target
    return np.tile((0.0, 1.0, 0.0), (3, 1)) @ _light(source, adapted) if target.startswith("Gra") else np.linalg.inv(_light(target, adapted)) @ _light(source, adapted)


def _curve(v: str, name: str, decode: bool) -> str:
    """The transfer function of a described encoding in SQL."""
    kind = name.split("_")[-1]
    hlg, pq = (color.HLG_A, color.HLG_B, color.HLG_C), (color.PQ_M1, color.PQ_M2, color.PQ_C1, color.PQ_C2, color.PQ_C3)
    if kind == "Lin":
        return v
    if kind == "SRG":
        knee = color.SRGB_KNEE / 255
        return f"CASE WHEN {v} <= {knee} THEN {v} / 12.92 ELSE POW(({v} + 0.055) / 1.055, 2.4) END" if decode else f"CASE WHEN {v} <= {knee / 12.92} THEN {v} * 12.92 ELSE 1.055 * POW({v}, 1 / 2.4) - 0.055 END"
    if kind == "HLG":
        a, b, c = hlg
        return f"CASE WHEN {v} <= 0.5 THEN {v} * {v} / 3 ELSE (EXP(({v} - {c}) / {a}) + {b}) / 12 END" if decode else f"CASE WHEN {v} <= 1.0 / 12 THEN SQRT(3 * {v}) ELSE {a} * LN(GREATEST(12 * {v} - {b}, 1e-9)) + {c} END"
    if kind == "PeQ":
        m, n, a, b, c = pq
        power = f"POW({v}, 1 / {n}::DOUBLE)"
        return f"POW(GREATEST({power} - {a}, 0) / ({b} - {c} * {power}), 1 / {m}::DOUBLE)" if decode else f"CASE WHEN {v} = 0 THEN 0 ELSE POW(({a} + {b} * POW({v}, {m}::DOUBLE)) / (1 + {c} * POW({v}, {m}::DOUBLE)), {n}::DOUBLE) END"
    return f"POW({v}, {'1 / ' if decode else ''}{float(kind[1:])}::DOUBLE)"


def _curves(by: str, v: str, encodings: tuple, decode: bool) -> str:
    return f"SIGN({v}) * CASE {by} " + " ".join(f"WHEN {k} THEN {_curve(f'ABS({v})', name, decode)}" for k, name in enumerate(encodings)) + " END"


_PAIRS = ", ".join(f"({i}, {j}, " + ", ".join(f"{x!r}::DOUBLE" for x in _between(a, b).ravel().tolist()) + ")" for i, a in enumerate(_SOURCES) for j, b in enumerate(_TARGETS))


@query(
    f"""WITH p AS (SELECT image_id, y, x, (image_id + y) % {len(_SOURCES)} AS s, x % {len(_TARGETS)} AS t, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM {_RGB}),
l AS (SELECT image_id, y, x, s, t, {', '.join(f"{_curves('s', c, _SOURCES, True)} AS {c}" for c in 'rgb')} FROM p),
m AS (SELECT image_id, y, x, t, {', '.join(f"m{3 * k} * r + m{3 * k + 1} * g + m{3 * k + 2} * b AS {c}" for k, c in enumerate('rgb'))} FROM l JOIN (VALUES {_PAIRS}) k(s, t, {', '.join(f'm{k}' for k in range(9))}) USING (s, t))
SELECT image_id, y, x, {', '.join(f"{_curves('t', c, _TARGETS, False)} AS {c}" for c in 'rgb')} FROM m""",
    "image_id:l y:l x:l r:d g:d b:d", 5,
)
def converted_colours(spark, sf_dir):
    """Cells of images in five encodings, turned into six others, one of them gray and one as measured."""
    pick = lambda at, values: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    cells = _rgb(spark, sf_dir).select("image_id", "y", "x", *[(F.col(c) / 255).alias(c) for c in "rgb"], pick(F.col("image_id") + F.col("y"), _SOURCES).alias("source"), pick(F.col("x"), _TARGETS).alias("target"))
    return colorspace.convert(cells).select("image_id", "y", "x", "r", "g", "b")


_OWN_PRIMARIES = ("SRG", "202", "AP1")
_MOVED = lambda k: f"FLOOR(ABS(embedding[{k + 1}]::DOUBLE) * 1000) % 50 / 10000"
_DET = "({0} * ({5} - {4}) - {1} * ({5} - {3}) + {2} * ({4} - {3}))".format  # of a matrix whose middle row is ones
_SEEN = [" + ".join(f"{float(_CONES[k][i])!r} * o{3 * i + j}" for i in range(3)) for k in range(3) for j in range(3)]
_COFACTOR = lambda i, j: "(a{} * a{} - a{} * a{})".format(*[3 * ((i + p) % 3) + (j + q) % 3 for p, q in ((1, 1), (2, 2), (1, 2), (2, 1))])


@query(
    f"""WITH e AS (SELECT vec_id, vec_id % 7 = 0 AS gray, {', '.join(f"{names.WHITE_POINTS['D65'][k]} + {_MOVED(k)} AS w{k}" for k in range(2))}, {', '.join(f"{[float(names.PRIMARIES[n][k]) for n in _OWN_PRIMARIES]!r}[vec_id % 3 + 1] + {_MOVED(2 + k)} AS p{k}" for k in range(6))} FROM embeddings),
c AS (SELECT vec_id, gray, w0 / w1 AS wx, (1 - w0 - w1) / w1 AS wz, {', '.join(f"p{2 * k} / p{2 * k + 1} AS x{c}, (1 - p{2 * k} - p{2 * k + 1}) / p{2 * k + 1} AS z{c}" for k, c in enumerate('rgb'))} FROM e),
d AS (SELECT *, {_DET('wx', 'xg', 'xb', 'wz', 'zg', 'zb')} / {_DET('xr', 'xg', 'xb', 'zr', 'zg', 'zb')} AS sr, {_DET('xr', 'wx', 'xb', 'zr', 'wz', 'zb')} / {_DET('xr', 'xg', 'xb', 'zr', 'zg', 'zb')} AS sg, {_DET('xr', 'xg', 'wx', 'zr', 'zg', 'wz')} / {_DET('xr', 'xg', 'xb', 'zr', 'zg', 'zb')} AS sb FROM c),
o AS (SELECT vec_id, gray, wx, wz, {', '.join(f"CASE WHEN gray THEN {w} / 3 ELSE {(row + c + ' * ' if row else '') + 's' + c} END AS o{3 * i + j}" for i, (row, w) in enumerate((('x', 'wx'), ('', '1.0::DOUBLE'), ('z', 'wz'))) for j, c in enumerate('rgb'))} FROM d),
q AS (SELECT *, {', '.join(f"({_SEEN[3 * k + j]}) * {float((_CONES @ _D50)[k])!r} / ({float(_CONES[k][0])!r} * wx + {float(_CONES[k][1])!r} + {float(_CONES[k][2])!r} * wz) AS q{3 * k + j}" for k in range(3) for j in range(3))} FROM o),
a AS (SELECT *, {', '.join(' + '.join(f"({float(np.linalg.inv(_CONES)[i][k])!r}) * q{3 * k + j}" for k in range(3)) + f" AS a{3 * i + j}" for i in range(3) for j in range(3))} FROM q),
b AS (SELECT *, [{', '.join(f'o{k}' for k in range(9))}] AS own, [{', '.join(f'a{k}' for k in range(9))}] AS adapted, CASE WHEN gray THEN [0.0, 1, 0, 0, 1, 0, 0, 1, 0] ELSE [{', '.join(f"{_COFACTOR(j, i)} / (a0 * {_COFACTOR(0, 0)} + a1 * {_COFACTOR(0, 1)} + a2 * {_COFACTOR(0, 2)})" for i in range(3) for j in range(3))}] END AS back FROM a)
SELECT vec_id, i, own[i + 1] AS own, adapted[i + 1] AS adapted, back[i + 1] AS back FROM b, (SELECT range AS i FROM range(9))""",
    "vec_id:l i:l own:d adapted:d back:d", 6,
)
def profile_matrices(spark, sf_dir):
    """Matrices of spaces with chromaticities of their own, every seventh gray, to the connection space and back."""
    moved = lambda k: F.floor(F.abs(F.get("block", F.lit(k))) * 1000) % 50 / 10000
    base = lambda k: F.element_at(F.array(*[F.lit(float(names.PRIMARIES[n][k])) for n in _OWN_PRIMARIES]), (F.col("vec_id") % 3 + 1).cast("int"))
    own = _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("name"), F.array(*[F.lit(names.WHITE_POINTS["D65"][k]) + moved(k) for k in range(2)]).alias("white"), F.array(*[base(k) + moved(2 + k) for k in range(6)]).alias("primaries"),
        F.lit("Lin").alias("transfer"), F.lit(None).cast("double").alias("gamma"), F.lit(False).alias("absolute"), (F.col("vec_id") % 7 == 0).alias("gray"),
    )
    rows = colorspace.profiles(own).select("name", F.posexplode(F.arrays_zip("own", "adapted", "adapted_back")).alias("i", "m"))
    return rows.select(F.col("name").alias("vec_id"), "i", "m.own", "m.adapted", F.col("m.adapted_back").alias("back"))


# Coefficients of other block sizes ----------------------------------------------------------------------------


def _small_coefficients(spark, sf_dir) -> DataFrame:
    """(m, coefficients): four 8 x 8 blocks' coefficients, each quarter those of one block."""
    parts = transforms.parts(F.col("block"), 16, 8)
    return _mosaic(spark, sf_dir).select("m", transforms.joined(F.transform(parts, lambda b: blocks.dct2d(b, 8)), 16, 8).alias("coefficients"))


@query(f"SELECT v.m, p.k * 16 + q.k AS i, SUM(v.v * p.b * q.b) AS v FROM {_BIG} v JOIN {_basis_sql(16)} p ON p.j = v.i // 16 JOIN {_basis_sql(16)} q ON q.j = v.i % 16 GROUP BY ALL", "m:l i:l v:d", 5)
def rebased_coefficients(spark, sf_dir):
    """Coefficients of 16 x 16 blocks from those of their quarters, without pixels."""
    return _small_coefficients(spark, sf_dir).select("m", F.posexplode(transforms.rebase(F.col("coefficients"), 16)).alias("i", "v"))


@query(f"SELECT vec_id, i, v FROM {_DCT} WHERE vec_id // 4 < (SELECT COUNT(*) // 4 FROM embeddings)", "vec_id:l i:l v:d", 5)
def split_coefficients(spark, sf_dir):
    """Coefficients of the quarters from those of the 16 x 16 block that they form."""
    whole = _mosaic(spark, sf_dir).select("m", blocks.dct2d(F.col("block"), 16).alias("whole"))
    quarters = whole.select("m", F.posexplode(transforms.parts(transforms.unbase(F.col("whole"), 16), 16, 8)).alias("part", "small"))
    return quarters.select((F.col("m") * 4 + F.col("part")).alias("vec_id"), F.posexplode("small").alias("i", "v"))


# Closed loop ----------------------------------------------------------------------------------------------------

_TARGET = 0.05
_STEP = f"({search.LEAST_STEP} * POW(2.0, {{}} / 4.0))"


def _error_sql(state: str, level: str) -> str:
    """(vec_id, error) of decoding with the step of each block's level."""
    width = _STEP.format(level)
    return f"""SELECT o.vec_id, MAX(ABS(o.v - d.v)) AS error FROM {_CELLS} o JOIN (SELECT c.vec_id, p.j * 8 + q.j AS i, SUM({width} * FLOOR(c.v / {width} + 0.5) * p.b * q.b) AS v
FROM coefficients c JOIN {state} s USING (vec_id) JOIN {_BASIS} p ON p.k = c.i // 8 JOIN {_BASIS} q ON q.k = c.i % 8 GROUP BY ALL) d USING (vec_id, i) GROUP BY o.vec_id"""


def _search_sql() -> str:
    rounds = (search.LEVELS - 1).bit_length()
    ctes = [f"coefficients AS MATERIALIZED (SELECT * FROM {_DCT})", f"s0 AS MATERIALIZED (SELECT vec_id, 0 AS low, {search.LEVELS} AS high FROM embeddings)"]
    for k in range(rounds):
        ctes.append(f"e{k} AS MATERIALIZED ({_error_sql(f's{k}', '((s.low + s.high) // 2)')})")
        ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT vec_id, CASE WHEN error <= {_TARGET} THEN (low + high) // 2 ELSE low END AS low, CASE WHEN error <= {_TARGET} THEN high ELSE (low + high) // 2 END AS high FROM s{k} JOIN e{k} USING (vec_id))")
    return f"WITH {', '.join(ctes)} SELECT vec_id, low AS level, {_STEP.format('low')} AS step, error, CAST(error <= {_TARGET} OR low = 0 AS BIGINT) AS settled, {rounds} AS rounds FROM s{rounds} JOIN ({_error_sql(f's{rounds}', 's.low')}) USING (vec_id)"


@query(_search_sql(), "vec_id:l level:l step:d error:d settled:l rounds:l")
def closed_loop_steps(spark, sf_dir):
    """The largest quantisation step of each block that the search finds to keep the decoded error within target."""
    found = search.largest_step(_embeddings(spark, sf_dir), "block", _TARGET)
    return found.select("vec_id", "level", "step", "error", ((F.col("error") <= _TARGET) | (F.col("level") == 0)).cast("long").alias("settled"), "rounds")


# Contexts ---------------------------------------------------------------------------------------------------------

_KINDS = f"SELECT 0 AS grp, context, value AS symbol, COUNT(*) AS n FROM (SELECT *, {_CONTEXT} AS context FROM {_TOKENS}) GROUP BY ALL"


@query(clusters_sql(_KINDS, TABLE_BITS, CLUSTER_ROUNDS), "grp:l context:l cluster:l symbols:l bits:d", 4)
def context_clusters(spark, sf_dir):
    """The contexts of coefficient tokens that share a table, by cost, and what each shared table codes."""
    counts = tokens.context_histograms(_tokens(spark, sf_dir), "context", "value").select(F.lit(0).alias("grp"), "context", F.col("value").alias("symbol"), "n")
    return clusters.merge_and_price(counts, TABLE_BITS, CLUSTER_ROUNDS)


# Coefficients under contexts, and groups of them ----------------------------------------------------------------
# 192 embeddings are an image of three planes of 8 x 8 blocks. Steps grow along the scan, so that runs of zeros do as well.

_SCANNED = f"""SELECT vec_id, vec_id // 192 AS image_id, vec_id % 192 // 64 AS c, vec_id % 64 // 8 AS "by", vec_id % 8 AS bx, k - 1 AS place,
CAST(SIGN(v) * FLOOR(ABS(v) * 24 / (1 + (k - 1) / 4.0::DOUBLE) + 0.5) AS BIGINT) AS q FROM (SELECT vec_id, k, embedding[{_ORDER}[k] + 1]::DOUBLE AS v FROM embeddings, (SELECT range AS k FROM range(1, 65)))"""
_EXPECTED = "CASE WHEN top IS NOT NULL AND lft IS NOT NULL THEN (top + lft + 1) // 2 ELSE COALESCE(top, lft, 32) END"
_LEFT = [0 if x is None else x for x in coefficients.LEFT_CONTEXT]
_SYMBOLS = f"""WITH s AS MATERIALIZED ({_SCANNED}),
b AS (SELECT vec_id, image_id, c, "by", bx, COUNT(*) FILTER (WHERE q <> 0 AND place > 0) AS n FROM s GROUP BY ALL),
t AS (SELECT *, LAG(n) OVER (PARTITION BY image_id, c, bx ORDER BY "by") AS top, LAG(n) OVER (PARTITION BY image_id, c, "by" ORDER BY bx) AS lft FROM b),
v AS (SELECT vec_id, c, place, COALESCE(LAG(place) OVER w, 0) AS prev, CASE WHEN q > 0 THEN 2 * q ELSE -2 * q - 1 END AS packed, COUNT(*) OVER (PARTITION BY vec_id ORDER BY place DESC) AS remaining FROM s WHERE q <> 0 AND place > 0 WINDOW w AS (PARTITION BY vec_id ORDER BY place)),
e AS (SELECT *, (place - prev - 1) // 16 AS escapes, CAST(FLOOR(LOG2(packed + 1)) AS BIGINT) AS width, k FROM v, (SELECT range AS k FROM range(4)) WHERE k <= (place - prev - 1) // 16),
symbols AS (SELECT vec_id, 3 * (({_EXPECTED}) // 2) + c AS context, n AS symbol, 0 AS nbits, 0 AS bits FROM t
UNION ALL SELECT vec_id, 96 + 105 * c + {_LEFT}[remaining + 1] + {list(coefficients.PLACE_CONTEXT)}[prev + 16 * k + 1], CASE WHEN k = escapes THEN (place - prev - 1) % 16 * 16 + width ELSE 240 END, CASE WHEN k = escapes THEN width ELSE 0 END, CASE WHEN k = escapes THEN packed + 1 - (1 << width) ELSE 0 END FROM e)"""


def _scanned_blocks(spark, sf_dir) -> DataFrame:
    k = F.col("vec_id")
    q = F.transform(tokens.scanned(F.col("block"), blocks.zigzag()), lambda v, i: (F.signum(v) * F.floor(F.abs(v) * 24 / (1 + i / 4) + 0.5)).cast("long"))
    return _embeddings(spark, sf_dir).select("vec_id", F.floor(k / 192).alias("image_id"), F.floor(k % 192 / 64).alias("c"), F.floor(k % 64 / 8).alias("by"), (k % 8).alias("bx"), q.alias("q"))


@query(f"{_SYMBOLS} SELECT vec_id, context, symbol, nbits, bits FROM symbols", "vec_id:l context:l symbol:l nbits:l bits:l")
def block_symbols(spark, sf_dir):
    """Counts and values of all blocks as symbols, with their contexts and the bits that follow them."""
    return coefficients.block_symbols(_scanned_blocks(spark, sf_dir), "q").select("vec_id", F.explode("symbols").alias("t")).select("vec_id", "t.*")


@query(f"{_SYMBOLS} SELECT context, SUM(n) AS symbols, SUM(extra) AS extra, SUM(n) * LOG2(SUM(n)) - SUM(n * LOG2(n)) AS bits FROM (SELECT context, symbol, COUNT(*) AS n, SUM(nbits) AS extra FROM symbols GROUP BY ALL) GROUP BY context", "context:l symbols:l extra:l bits:d", 4)
def symbol_bits(spark, sf_dir):
    """Symbols of every context, the bits that follow them, and those that a table of its own takes for them."""
    counts = coefficients.histograms(coefficients.block_symbols(_scanned_blocks(spark, sf_dir), "q"))
    total, n = F.sum("n"), F.col("n")
    return counts.groupBy("context").agg(total.alias("symbols"), F.sum("extra").alias("extra"), (total * F.log2(total) - F.sum(n * F.log2(n))).alias("bits"))


@query(f'SELECT image_id, c, "by", bx, place, q FROM ({_SCANNED}) WHERE q <> 0 AND place > 0', "image_id:l c:l by:l bx:l place:l q:l")
def coded_groups(spark, sf_dir):
    """Values of groups that were coded under shared tables into few files, and decoded group by group from their byte ranges."""
    symbols = coefficients.block_symbols(_scanned_blocks(spark, sf_dir), "q")
    context_map, shares = coefficients.tables(coefficients.histograms(symbols))
    index = spans.write_spans(coefficients.encode_groups(symbols, context_map, shares), ["image_id"])
    decoded = coefficients.decode_groups(spans.read_spans(index), context_map, shares)
    return decoded.select("image_id", "c", "by", "bx", F.posexplode("values").alias("place", "q")).where("q <> 0")


# Prediction between blocks --------------------------------------------------------------------------------------
# 64 embeddings are an image of 8 x 8 blocks; the last one may lack some.

_MEAN_STEP, _STEP_LOW = 0.04, 0.03


def _values(matrix) -> str:
    return "(VALUES " + ", ".join(f"({k}, {j}, {w!r}::DOUBLE)" for k, row in enumerate(matrix) for j, w in enumerate(row)) + ")"


def _rounded(x: str, step: float) -> str:
    return f"SIGN({x}) * FLOOR(ABS({x}) / {step!r}::DOUBLE + 0.5)"


_BLUR = "(VALUES " + ", ".join(f"({dx}, {dy}, {w!r}::DOUBLE)" for dx, dy, w in stencil.symmetric3(*lowfreq.BLUR3)) + ")"
_PREDICTED = f"""WITH d AS MATERIALIZED (SELECT vec_id, vec_id // 64 AS image_id, vec_id % 64 // 8 AS "by", vec_id % 8 AS bx, i, v FROM {_DCT}),
f AS (SELECT vec_id, image_id, "by", bx, {_rounded('v', _MEAN_STEP)} AS q, {_rounded('v', _MEAN_STEP)} * {_MEAN_STEP}::DOUBLE AS v FROM d WHERE i = 0),
h AS (SELECT image_id, "by" * 2 + j // 2 AS y, bx * 2 + j % 2 AS x, v / 8 AS m FROM f, (SELECT range AS j FROM range(4))),
l AS (SELECT vec_id, j // 2 AS hy, j % 2 AS hx, SUM(w * COALESCE(m, 0)) AS m FROM (SELECT f.*, j, w, LEAST(GREATEST("by" * 2 + j // 2 + dy, 0), 15) AS y, LEAST(GREATEST(bx * 2 + j % 2 + dx, 0), 15) AS x FROM f, (SELECT range AS j FROM range(4)), {_BLUR} t(dx, dy, w)) LEFT JOIN h USING (image_id, y, x) GROUP BY ALL),
e AS (SELECT vec_id, p.k * 8 + q.k AS i, SUM(m * p.w * q.w) AS e FROM l JOIN {_values(lowfreq.halves_to_low())} p(k, h, w) ON p.h = hy JOIN {_values(lowfreq.halves_to_low())} q(k, h, w) ON q.h = hx GROUP BY ALL),
low AS MATERIALIZED (SELECT d.vec_id, image_id, "by", bx, i, {_rounded('(v - e)', _STEP_LOW)} AS q, e + {_rounded('(v - e)', _STEP_LOW)} * {_STEP_LOW}::DOUBLE AS v FROM d JOIN e USING (vec_id, i) WHERE i > 0 UNION ALL SELECT vec_id, image_id, "by", bx, 0, q, v FROM f),
g AS (SELECT image_id, "by" * 2 + p.k AS y, bx * 2 + q.k AS x, SUM(v * p.w * q.w) AS m FROM low JOIN {_values(lowfreq.low_to_halves())} p(k, f, w) ON p.f = i // 8 JOIN {_values(lowfreq.low_to_halves())} q(k, f, w) ON q.f = i % 8 GROUP BY image_id, "by", bx, p.k, q.k),
c AS (SELECT vec_id, j // 4 AS cy, j % 4 AS cx, COALESCE(m, 0) AS m FROM (SELECT f.vec_id, image_id, j, LEAST(GREATEST("by" * 2 + j // 4 - 1, 0), 15) AS y, LEAST(GREATEST(bx * 2 + j % 4 - 1, 0), 15) AS x FROM f, (SELECT range AS j FROM range(16))) LEFT JOIN g USING (image_id, y, x)),
a AS (SELECT vec_id, p.k * 8 + q.k AS i, SUM(m * p.w * q.w) AS e FROM c JOIN {_values(lowfreq.enlarged_dct())} p(k, h, w) ON p.h = cy JOIN {_values(lowfreq.enlarged_dct())} q(k, h, w) ON q.h = cx GROUP BY ALL),
high AS (SELECT vec_id, i, {_rounded('(v - e)', _STEP_LOW)} AS q, e + {_rounded('(v - e)', _STEP_LOW)} * {_STEP_LOW}::DOUBLE AS v FROM d JOIN a USING (vec_id, i) WHERE i >= 16 OR i % 8 >= 2)"""


def _predicted(spark, sf_dir) -> DataFrame:
    k = F.col("vec_id")
    rows = _embeddings(spark, sf_dir).select(F.floor(k / 64).alias("image_id"), F.lit(0).alias("c"), F.floor(k % 64 / 8).alias("by"), (k % 8).alias("bx"), blocks.dct2d(F.col("block")).alias("v"))
    return lowfreq.encode(rows, "v", 8, 8, _MEAN_STEP, _STEP_LOW)


def _numbered(values: str):
    return (F.col("image_id") * 64 + F.col("by") * 8 + F.col("bx")).alias("vec_id"), F.posexplode(values).alias("i", values)


@query(f"{_PREDICTED} SELECT vec_id, i, q FROM low UNION ALL SELECT vec_id, i, q FROM high", "vec_id:l i:l q:l")
def neighbour_residuals(spark, sf_dir):
    """What is left of frequencies after prediction from the blocks around, in steps."""
    return _predicted(spark, sf_dir).select(*_numbered("q"))


@query(f"{_PREDICTED} SELECT vec_id, i, v FROM low UNION ALL SELECT vec_id, i, v FROM high", "vec_id:l i:l v:d", 5)
def neighbour_decoded(spark, sf_dir):
    """Frequencies as a decoder predicts and corrects them."""
    return lowfreq.decode(_predicted(spark, sf_dir), "q", 8, 8, _MEAN_STEP, _STEP_LOW).select(*_numbered("v"))


# Descriptions of tables ------------------------------------------------------------------------------------------
# Each embedding gives one description of one to five bands; each four form a tile that chooses among four tables.

_PARAMETER = "CASE WHEN k = 0 THEN 8 + FLOOR(ABS(embedding[1]::DOUBLE) * 1000) / 10 ELSE embedding[k + 1]::DOUBLE * 4 END"
_UNITS = f"SELECT vec_id, k, 1 + vec_id % 5 AS n, CAST(FLOOR(({_PARAMETER}) * 64 + 0.5) AS BIGINT) AS u FROM embeddings, (SELECT range AS k FROM range(5)) WHERE k <= vec_id % 5"
_CANDIDATES = ((quanttables.BANDS, (24.0, -0.5, -1.0, -0.25)), (quanttables.BANDS, (12.0,)), (quanttables.OCTAVES, (40.0, 20.0, 8.0, 3.0)), (quanttables.BANDS, (6.0, -1.0, -1.0)))
_PER_ERROR = 300.0


def _candidate_weights(kind: int, parameters: tuple) -> list[float]:
    if kind == quanttables.OCTAVES:
        return [parameters[max(i % 8, i // 8).bit_length()] for i in range(64)]
    bands = _bands(*parameters)
    places = [math.hypot(i % 8, i // 8) / 7 * (len(bands) - 1) / quanttables.FARTHEST for i in range(64)]
    return [bands[int(p)] * ((bands + bands[-1:])[int(p) + 1] / bands[int(p)]) ** (p - int(p)) for p in places]


_CHOICES = f"""SELECT tile, choice, cost FROM (SELECT tile, choice, SUM(CASE WHEN q = 0 THEN 0 ELSE 2 * FLOOR(LOG2(CASE WHEN q > 0 THEN 2 * q ELSE -2 * q - 1 END + 1)) + 1 END + {_PER_ERROR} * (v - q / w) * (v - q / w)) AS cost
FROM (SELECT vec_id // 4 AS tile, t.k AS choice, v, w, SIGN(v) * FLOOR(ABS(v) * w + 0.5) AS q FROM {_DCT} d JOIN {_values([_candidate_weights(*c) for c in _CANDIDATES])} t(k, i, w) ON t.i = d.i) GROUP BY tile, choice) QUALIFY ROW_NUMBER() OVER (PARTITION BY tile ORDER BY cost, choice) = 1"""


def _descriptions(spark, sf_dir) -> DataFrame:
    first = 8 + F.floor(F.abs(F.get("block", F.lit(0))) * 1000) / 10
    parameters = F.concat(F.array(first), F.transform(F.slice("block", F.lit(2), (F.col("vec_id") % 5).cast("int")), lambda v: v * 4))
    return _embeddings(spark, sf_dir).select("vec_id", quanttables.table_bytes(F.lit(quanttables.BANDS), parameters).alias("bytes"))


def _choices(spark, sf_dir) -> DataFrame:
    rows = _embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).alias("tile"), blocks.dct2d(F.col("block")).alias("v"))
    return quanttables.best_tables(rows, ["tile"], "v", _CANDIDATES, _PER_ERROR)


@query(f"SELECT vec_id, printf('00%02x', MAX(n)) || string_agg(printf('%02x%02x', (u + 65536) % 256, (u + 65536) % 65536 // 256), '' ORDER BY k) AS bytes FROM ({_UNITS}) GROUP BY vec_id", "vec_id:l bytes:s")
def table_bytes(spark, sf_dir):
    """Descriptions of quantisation tables as they are written."""
    return _descriptions(spark, sf_dir).select("vec_id", F.lower(F.hex("bytes")).alias("bytes"))


@query(
    f"""WITH b AS (SELECT vec_id, n, k, PRODUCT(CASE WHEN k = 0 THEN p WHEN p > 0 THEN 1 + p ELSE 1 / (1 - p) END) OVER (PARTITION BY vec_id ORDER BY k) AS band FROM (SELECT *, u / 64.0::DOUBLE AS p FROM ({_UNITS}))),
a AS (SELECT vec_id, i, SQRT((i % 8) * (i % 8) + (i // 8) * (i // 8)) / 7.0::DOUBLE * (vec_id % 5) / {quanttables.FARTHEST!r}::DOUBLE AS pos FROM embeddings, (SELECT range AS i FROM range(64)))
SELECT a.vec_id, a.i, GREATEST(x.band * POW(COALESCE(y.band, x.band) / x.band, pos - FLOOR(pos)), {quanttables.LEAST_WEIGHT}) AS w FROM a JOIN b x ON x.vec_id = a.vec_id AND x.k = FLOOR(pos) LEFT JOIN b y ON y.vec_id = a.vec_id AND y.k = FLOOR(pos) + 1""",
    "vec_id:l i:l w:d", 7,
)
def table_weights(spark, sf_dir):
    """Weights of the tables whose descriptions were read from their bytes."""
    read = _descriptions(spark, sf_dir).select("vec_id", quanttables.read_table(F.col("bytes")).alias("t"))
    return read.select("vec_id", F.posexplode(quanttables.weights(F.col("t.kind"), F.col("t.parameters"))).alias("i", "w"))


@query(_CHOICES, "tile:l choice:l cost:d", 4)
def best_tables(spark, sf_dir):
    """The table that each tile's blocks cost least under, in bits and error."""
    return _choices(spark, sf_dir)


@query(f"""WITH t AS (SELECT tile // 16 AS image_id, tile, choice, CASE WHEN choice = LAG(choice) OVER (PARTITION BY tile // 16 ORDER BY tile) THEN 0 ELSE 1 END AS new FROM ({_CHOICES})),
r AS (SELECT image_id, choice, MIN(tile) AS first, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY image_id ORDER BY tile) AS run FROM t) GROUP BY image_id, run, choice)
SELECT image_id, string_agg(printf('%02x%02x', n - 1, choice), '' ORDER BY first) AS code, SUM(n) AS tiles, SUM(n * choice) AS total FROM r GROUP BY image_id""", "image_id:l code:s tiles:l total:l")
def table_fields(spark, sf_dir):
    """Which table the tiles of an image take, as runs; and how many tiles and choices are read back from them."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("tile", "choice"))), lambda s: s["choice"])
    fields = _choices(spark, sf_dir).groupBy(F.floor(F.col("tile") / 16).alias("image_id")).agg(quanttables.field_bytes(in_order).alias("code"))
    read = quanttables.read_field(F.col("code"))
    return fields.select("image_id", "code", F.size(read).alias("tiles"), F.aggregate(read, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# Lines with knots ------------------------------------------------------------------------------------------------

_SPAN, _EVERY, _KNOT_STEP = 4320, 8, 2


def _fit_ctes(name: str, points: str, keys: str) -> str:
    """CTEs that end in `name` (keys, knot, h): the fit of points (keys, p, v), p in steps; keys are joined by commas."""
    near = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""{name}_s AS MATERIALIZED (SELECT {keys}, knot, SUM(own) AS own, SUM(nxt) AS nxt, SUM(v) AS v FROM (SELECT {keys}, CAST(FLOOR(p) AS BIGINT) AS knot, (1 - p + FLOOR(p)) * (1 - p + FLOOR(p)) AS own, (1 - p + FLOOR(p)) * (p - FLOOR(p)) AS nxt, (1 - p + FLOOR(p)) * v AS v FROM ({points})
UNION ALL SELECT {keys}, CAST(FLOOR(p) AS BIGINT) + 1, (p - FLOOR(p)) * (p - FLOOR(p)), 0, (p - FLOOR(p)) * v FROM ({points}) WHERE p > FLOOR(p)) GROUP BY ALL),
{name}_k AS MATERIALIZED (SELECT {of('r')}, r.knot, r.last, COALESCE(own, 0) AS own, COALESCE(nxt, 0) AS nxt, COALESCE(v, 0) AS v FROM (SELECT {keys}, last, UNNEST(range(last + 1)) AS knot FROM (SELECT {keys}, MAX(knot) AS last FROM {name}_s GROUP BY ALL)) r LEFT JOIN {name}_s s ON {near('r', 's')} AND r.knot = s.knot),
{name}_f AS (SELECT {keys}, knot, last, nxt / (own + {fits.RIDGE}) AS link, v / (own + {fits.RIDGE}) AS up, nxt FROM {name}_k WHERE knot = 0
UNION ALL SELECT {of('k')}, k.knot, k.last, k.nxt / (k.own + {fits.RIDGE} - f.nxt * f.link), (k.v - f.nxt * f.up) / (k.own + {fits.RIDGE} - f.nxt * f.link), k.nxt FROM {name}_f f JOIN {name}_k k ON {near('f', 'k')} AND k.knot = f.knot + 1),
{name}_b AS (SELECT {keys}, knot, up AS h FROM {name}_f WHERE knot = last UNION ALL SELECT {of('f')}, f.knot, f.up - f.link * b.h FROM {name}_b b JOIN {name}_f f ON {near('f', 'b')} AND f.knot = b.knot - 1),
{name} AS MATERIALIZED (SELECT {of('b')}, b.knot, CASE WHEN own > 0 THEN h END AS h FROM {name}_b b JOIN {name}_k k ON {near('b', 'k')} AND b.knot = k.knot)"""


_MINUTES = f"SELECT event_type, date_sub('minute', TIMESTAMP '2024-01-01 00:00:00', ts) / {_SPAN}.0::DOUBLE AS p, value AS v FROM events WHERE value IS NOT NULL AND ts IS NOT NULL"
_LINES_OF_EVENTS = f"WITH RECURSIVE {_fit_ctes('fit', _MINUTES, 'event_type')}"
_KNOTS = f"""WITH RECURSIVE {_fit_ctes('along', f"SELECT image_id, c, y, x / {_EVERY}.0::DOUBLE AS p, v FROM {MIX} WHERE v <> 0", 'image_id, c, y')},
{_fit_ctes('down', f"SELECT image_id, c, knot AS x, y / {_EVERY}.0::DOUBLE AS p, h AS v FROM along WHERE h IS NOT NULL", 'image_id, c, x')}"""


def _minutes(spark, sf_dir) -> DataFrame:
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", minute.cast("double").alias("minute"), "value")


def _knots(spark, sf_dir) -> DataFrame:
    return fits.plane_knots(make(spark, sf_dir, "mix"), _EVERY, exclude=0.0)


@query(f"{_LINES_OF_EVENTS} SELECT event_type, knot, h FROM fit", "event_type:s knot:l h:d", 5)
def event_lines(spark, sf_dir):
    """Values of each type of event over time as a line with a knot every three days."""
    fitted = fits.knot_fit(_minutes(spark, sf_dir), ["event_type"], "minute", "value", _SPAN)
    return fitted.select("event_type", F.posexplode("heights").alias("knot", "h"))


@query(f"{_LINES_OF_EVENTS} SELECT event_type, COUNT(*) AS n, AVG((v - e) * (v - e)) AS error FROM (SELECT m.*, a.h * (1 - p + FLOOR(p)) + COALESCE(b.h, 0) * (p - FLOOR(p)) AS e FROM ({_MINUTES}) m JOIN fit a ON a.event_type = m.event_type AND a.knot = FLOOR(p) LEFT JOIN fit b ON b.event_type = m.event_type AND b.knot = FLOOR(p) + 1) GROUP BY event_type", "event_type:s n:l error:d", 4)
def event_line_errors(spark, sf_dir):
    """How far values are from their type's line, squared and on average."""
    points = _minutes(spark, sf_dir).where("value is not null and minute is not null")
    fitted = fits.knot_fit(points, ["event_type"], "minute", "value", _SPAN)
    off = F.col("value") - fits.height_at(F.col("heights"), F.col("minute"), _SPAN)
    return points.join(fitted, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(off * off).alias("error"))


@query(f"{_KNOTS} SELECT image_id, c, knot AS y, x, h AS v FROM down", CELL, 5)
def plane_knots(spark, sf_dir):
    """Heights of a smooth surface through the cells of an image that aren't 0."""
    return _knots(spark, sf_dir)


@query(f"""{_KNOTS}, q AS (SELECT image_id, c, knot AS y, x, CAST(FLOOR(h / {_KNOT_STEP} + 0.5) AS BIGINT) AS v FROM down),
r AS (SELECT q.*, n.v AS n, w.v AS w, d.v AS nw FROM q LEFT JOIN q n ON n.image_id = q.image_id AND n.c = q.c AND n.x = q.x AND n.y = q.y - 1 LEFT JOIN q w ON w.image_id = q.image_id AND w.c = q.c AND w.y = q.y AND w.x = q.x - 1 LEFT JOIN q d ON d.image_id = q.image_id AND d.c = q.c AND d.x = q.x - 1 AND d.y = q.y - 1)
SELECT image_id, c, y, x, v - CASE WHEN nw IS NULL THEN COALESCE(w, n, 0) ELSE LEAST(GREATEST(n + w - nw, LEAST(n, w, nw)), GREATEST(n, w, nw)) END AS v FROM r""", "image_id:l c:l y:l x:l v:l")
def plane_knot_residuals(spark, sf_dir):
    """The surface's heights as they are written: in steps, less what the heights before let expect."""
    q = _knots(spark, sf_dir).withColumn("v", F.floor(F.col("v") / _KNOT_STEP + 0.5).cast("long"))
    return predict.gradient_residual(q).withColumn("v", F.col("v").cast("long"))


# Patches ----------------------------------------------------------------------------------------------------------

_SIDE, _USES, _ROUNDS = 3, 3, 14


def _patches_sql() -> str:
    """Windows of the sparse images, repeated ones in their order, and rounds in which those go that nothing better overlaps."""
    join = "p.image_id = q.image_id AND p.c = q.c AND ABS(p.x - q.x) < 3 AND ABS(p.y - q.y) < 3"
    ctes = [
        f"g AS MATERIALIZED (SELECT * FROM {DOTS})",
        "w AS MATERIALIZED (SELECT p.image_id, p.c, p.y, p.x, string_agg(CAST(q.v AS BIGINT), ',' ORDER BY q.y, q.x) AS content, MIN(q.v) AS low, MAX(q.v) AS high FROM g p JOIN g q ON p.image_id = q.image_id AND p.c = q.c AND q.x BETWEEN p.x AND p.x + 2 AND q.y BETWEEN p.y AND p.y + 2 WHERE p.x <= 14 AND p.y <= 9 GROUP BY ALL)",
        f"a0 AS MATERIALIZED (SELECT w.*, uses, ROW_NUMBER() OVER (ORDER BY uses DESC, string_split(content, ',')::BIGINT[], y, x, image_id) AS r FROM w JOIN (SELECT content, COUNT(*) AS uses FROM w WHERE low < high GROUP BY content HAVING COUNT(*) >= {_USES}) USING (content))",
    ]
    for k in range(_ROUNDS):
        ctes.append(f"c{k} AS MATERIALIZED (SELECT p.* FROM a{k} p JOIN (SELECT p.r, MIN(q.r) AS best FROM a{k} p JOIN a{k} q ON {join} GROUP BY p.r) b ON b.r = p.r AND b.best = p.r)")
        ctes.append(f"a{k + 1} AS MATERIALIZED (SELECT p.* FROM a{k} p WHERE NOT EXISTS (SELECT 1 FROM c{k} q WHERE {join}))")
    ctes.append("taken AS (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(_ROUNDS)) + ")")
    return "WITH " + ", ".join(ctes)


@query(_patches_sql() + " SELECT image_id, c, y, x, content, uses FROM taken", "image_id:l c:l y:l x:l content:s uses:l")
def repeated_patches(spark, sf_dir):
    """Where the patches of the dictionary are taken, and how often their content occurs."""
    taken = patches.placements(make(spark, sf_dir, "dots"), *size("dots"), _SIDE, _USES)
    return taken.withColumn("content", F.array_join(F.transform("content", lambda v: v.cast("long").cast("string")), ","))


@query(_patches_sql() + f", hit AS (SELECT t.image_id, t.c, t.y + i // 3 AS y, t.x + i % 3 AS x, string_split(content, ',')[i + 1]::DOUBLE AS p FROM taken t, (SELECT range AS i FROM range(9))) SELECT g.image_id, g.c, g.y, g.x, g.v - COALESCE(p, 0) AS v FROM {DOTS} g LEFT JOIN hit USING (image_id, c, y, x)")
def patches_subtracted(spark, sf_dir):
    """Images without the patches that the dictionary holds."""
    cells = make(spark, sf_dir, "dots")
    return patches.subtract(cells, patches.placements(cells, *size("dots"), _SIDE, _USES), _SIDE)
