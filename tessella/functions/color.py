"""Colour and transfer functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The opponent colour space's absorbance matrix and bias (per 255).
ABSORBANCE = (
    (0.29956550340058319, 0.63373087833825936, 0.077705617820981968),
    (0.22158691104574774, 0.68491388044116142, 0.096254234043612538),
    (0.20062661225219422, 0.070366199217588729, 0.5571760754215358),
)
ABSORBANCE_BIAS = (0.26786006338144885, 0.24494032763907073, 0.14255999980363571)

# BT.2100 hybrid log-gamma and perceptual quantiser.
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
PQ_M1, PQ_M2 = 2610.0 / 16384, 2523.0 / 4096 * 128
PQ_C1, PQ_C2, PQ_C3 = 3424.0 / 4096, 2413.0 / 4096 * 32, 2392.0 / 4096 * 32

#: sRGB's linear segment ends here, in 8-bit units.
SRGB_KNEE = 10.31475


def srgb_to_linear(v: Column) -> Column:
    """Both sides run from 0 to 255."""
    return F.when(v <= 0, 0.0).when(v <= SRGB_KNEE, v / 12.92).when(v >= 255, 255.0).otherwise(F.pow((v / 255 + 0.055) / 1.055, 2.4) * 255)


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v >= 255, 255.0).when(v <= SRGB_KNEE / 12.92, v * 12.92).otherwise((F.pow(v / 255, 1 / 2.4) * 1.055 - 0.055) * 255)


def xyb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Opponent colours of linear r, g, b from 0 to 255."""
    cone = []
    for row, bias in zip(ABSORBANCE, ABSORBANCE_BIAS, strict=True):
        mixed = (row[0] * r + row[1] * g + row[2] * b + bias) / 255
        cone.append(F.cbrt(F.greatest(mixed, F.lit(0.0))))
    return (cone[0] - cone[1]) * 0.5, (cone[0] + cone[1]) * 0.5, cone[2]


def inverse3(m) -> tuple[tuple[float, ...], ...]:
    """Inverse of a 3x3 matrix by cofactors."""
    cof = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum(m[0][j] * cof[0][j] for j in range(3))
    if det == 0:
        raise ValueError("the matrix has no inverse")
    return tuple(tuple(cof[j][i] / det for j in range(3)) for i in range(3))


def xyb_to_linear(x: Column, y: Column, b: Column) -> tuple[Column, Column, Column]:
    """Inverse of xyb, without clamping."""
    cubes = []
    for v, bias in zip((y + x, y - x, b), ABSORBANCE_BIAS, strict=True):
        cubes.append(v * v * v * 255 - bias)
    return tuple(sum((row[k] * cubes[k] for k in (1, 2)), row[0] * cubes[0]) for row in inverse3(ABSORBANCE))


def _yuv_rows(kr: float, kb: float) -> tuple[tuple[float, ...], ...]:
    """Studio-range luma and colour differences of a space with the given red and blue weights."""
    kg = 1 - kr - kb
    luma = (219 / 255 * kr, 219 / 255 * kg, 219 / 255 * kb)
    u = tuple(224 / 255 * x / (2 * (1 - kb)) for x in (-kr, -kg, 1 - kb))
    v = tuple(224 / 255 * x / (2 * (1 - kr)) for x in (1 - kr, -kg, -kb))
    return luma, u, v


YUV709 = _yuv_rows(0.2126, 0.0722)
YUV_OFFSET = (16 / 255, 128 / 255, 128 / 255)


def rgb_to_yuv(r: Column, g: Column, b: Column, bits: int = 8) -> tuple[Column, ...]:
    """Rec.709 studio range of r, g, b from 0 to 1: rounded and clamped to the bit depth."""
    top = (1 << bits) - 1
    return tuple(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(0.5 + top * (add + row[0] * r + row[1] * g + row[2] * b)))).cast("int") for row, add in zip(YUV709, YUV_OFFSET, strict=True))


def yuv_to_rgb(y: Column, u: Column, v: Column, bits: int = 8) -> tuple[Column, ...]:
    """Inverse of rgb_to_yuv, from 0 to 1 and not clamped."""
    top = (1 << bits) - 1
    parts = [x / top - add for x, add in zip((y, u, v), YUV_OFFSET, strict=True)]
    return tuple(row[0] * parts[0] + row[1] * parts[1] + row[2] * parts[2] for row in inverse3(YUV709))


def hlg_encode(v: Column) -> Column:
    """BT.2100 HLG signal of scene light from 0 to 1."""
    return F.when(v <= 1 / 12, F.sqrt(3 * F.greatest(v, F.lit(0.0)))).otherwise(HLG_A * F.log(F.greatest(12 * v - HLG_B, F.lit(1e-9))) + HLG_C)


def hlg_decode(s: Column) -> Column:
    return F.when(s <= 0.5, s * s / 3).otherwise((F.exp((s - HLG_C) / HLG_A) + HLG_B) / 12)


def pq_encode(v: Column) -> Column:
    """BT.2100 PQ signal of display light from 0 to 1 (10000 nits)."""
    p = F.pow(F.greatest(v, F.lit(0.0)), PQ_M1)
    return F.pow((PQ_C1 + PQ_C2 * p) / (1 + PQ_C3 * p), PQ_M2)


def pq_decode(s: Column) -> Column:
    p = F.pow(F.greatest(s, F.lit(0.0)), 1 / PQ_M2)
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * p), 1 / PQ_M1)


def alpha_blend(v: Column, alpha: Column, opaque: int, background: Column) -> Column:
    """Blend linear v over a linear background in gamma space; full and no opacity need no blending."""
    w = alpha / opaque
    mixed = srgb_to_linear(w * linear_to_srgb(v) + (1 - w) * linear_to_srgb(background))
    return F.when(alpha == 0, background).when(alpha == opaque, v).otherwise(mixed)


def heat(score: Column, good: float, bad: float, stops: tuple[tuple[float, ...], ...] = ((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1), (0.5, 0.5, 1.0), (1.0, 0.5, 0.5), (1.0, 1.0, 0.5), (1, 1, 1), (1, 1, 1))) -> tuple[Column, ...]:
    """Heat-map colour of a score: below `good` in the cold third, above `bad` in the hot third."""
    place = F.when(score < good, score / good * 0.3).when(score < bad, 0.3 + (score - good) / (bad - good) * 0.15).otherwise(0.45 + (score - bad) / (bad * 12) * 0.5)
    at = F.least(F.greatest(place * (len(stops) - 1), F.lit(0.0)), F.lit(len(stops) - 2.0))
    i = F.floor(at).cast("int")
    mix = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - i))
    pick = lambda c, k: F.element_at(F.array(*[F.lit(float(s[c])) for s in stops]), i + 1 + k)
    return tuple(F.round(255 * F.pow((1 - mix) * pick(c, 0) + mix * pick(c, 1), 0.5)).cast("int") for c in range(3))


def describe(space: Column, white: Column, primaries: Column, intent: Column, transfer: Column) -> Column:
    """Short name of an encoding, such as RGB_D65_SRG_Rel_Lin."""
    return F.concat_ws("_", space, white, primaries, intent, transfer)


# The opponent luma space on cube-root-like responses: absorbance of linear r, g, b from 0 to 1, the
# weight of the first response (the second has what is missing to 2), the centre and radius of the red-green axis,
# the scales of its channels, and the toe of its transfer function.
OPSIN_YUV = ((0.355028246972028, 0.589422218034148, 0.055549534993826), (0.250871605395556, 0.714937756329137, 0.034190638275308), (0.091915449087840, 0.165250230906774, 0.742834320005384))
OPSIN_YUV_RED, OPSIN_YUV_CENTRE, OPSIN_YUV_RADIUS = 1.001746913108605, 0.008714601398, 0.035065606236
OPSIN_YUV_SCALES = (219 / 255, 56 / 255, 33.6 / 255)
OPSIN_TOE, OPSIN_SLOPE = 0.04, 29.16


def opsin_yuv(r: Column, g: Column, b: Column, bits: int = 8, cube_root: Callable[[Column], Column] = F.cbrt) -> tuple[Column, ...]:
    """Opponent luma and differences of gamma-coded r, g, b from 0 to 1, rounded and clamped to the bit depth.

    Gray lies on the edge between two values of u, so the last bit of the cube root decides there.
    """
    # in this order of operations and from 0 to 1 throughout: gray lies on the edge between two values
    linear = [F.when(x <= 0, 0.0).when(x <= SRGB_KNEE / 255, x / 12.92).when(x >= 1, 1.0).otherwise(F.pow((x + 0.055) / 1.055, 2.4)) for x in (r, g, b)]
    response = []
    for row in OPSIN_YUV:
        v = sum((row[k] * linear[k] for k in (1, 2)), row[0] * linear[0])
        response.append(F.when(v < OPSIN_TOE / OPSIN_SLOPE, v * OPSIN_SLOPE).otherwise(cube_root(v) * 1.08 - 0.08))
    red, green = OPSIN_YUV_RED * response[0], (2 - OPSIN_YUV_RED) * response[1]
    both, axis = red + green, (red - green) / 2 - OPSIN_YUV_CENTRE
    parts = (0.0625 + OPSIN_YUV_SCALES[0] * both / 2, 0.5 + OPSIN_YUV_SCALES[1] * (response[2] - both / 2), 0.5 + OPSIN_YUV_SCALES[2] * axis / OPSIN_YUV_RADIUS)
    top = (1 << bits) - 1
    return tuple(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(0.5 + top * x))).cast("int") for x in parts)


def opsin_yuv_to_rgb(y: Column, u: Column, v: Column, bits: int = 8) -> tuple[Column, ...]:
    """Inverse of opsin_yuv, from 0 to 1."""
    top = (1 << bits) - 1
    luma, blue, axis = (y / top - 0.0625) / OPSIN_YUV_SCALES[0], (u / top - 0.5) / OPSIN_YUV_SCALES[1], (v / top - 0.5) / OPSIN_YUV_SCALES[2] * OPSIN_YUV_RADIUS
    responses = (luma + axis + OPSIN_YUV_CENTRE) / OPSIN_YUV_RED, (luma - axis - OPSIN_YUV_CENTRE) / (2 - OPSIN_YUV_RED), blue + luma
    cones = [F.when(x < OPSIN_TOE, x / OPSIN_SLOPE).otherwise(F.pow((x + 0.08) / 1.08, F.lit(3))) for x in responses]
    return tuple(linear_to_srgb(255 * sum((row[k] * cones[k] for k in (1, 2)), row[0] * cones[0])) / 255 for row in inverse3(OPSIN_YUV))


def xyz_matrix(primaries: tuple[float, ...], white: tuple[float, float]) -> tuple[tuple[float, ...], ...]:
    """Linear r, g, b of a space to XYZ: columns are the primaries, scaled so that equal parts are white."""
    columns = [(x / y, 1.0, (1 - x - y) / y) for x, y in zip(primaries[::2], primaries[1::2], strict=True)]
    m = tuple(tuple(c[i] for c in columns) for i in range(3))
    target = (white[0] / white[1], 1.0, (1 - white[0] - white[1]) / white[1])
    scale = [sum(row[k] * target[k] for k in range(3)) for row in inverse3(m)]
    return tuple(tuple(m[i][j] * scale[j] for j in range(3)) for i in range(3))


def between_spaces(source: tuple[float, ...], to: tuple[float, ...], white: tuple[float, float]) -> tuple[tuple[float, ...], ...]:
    """Matrix of linear r, g, b from one set of primaries to another of the same white."""
    a, b = xyz_matrix(source, white), inverse3(xyz_matrix(to, white))
    return tuple(tuple(sum(b[i][k] * a[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def transform(rgb: tuple[Column, Column, Column], matrix, decode=srgb_to_linear, encode=linear_to_srgb) -> tuple[Column, ...]:
    """r, g, b from 0 to 255 through decoding, a matrix on linear light, and encoding."""
    linear = [decode(x) for x in rgb]
    return tuple(encode(row[0] * linear[0] + row[1] * linear[1] + row[2] * linear[2]) for row in matrix)
