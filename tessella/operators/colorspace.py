"""Colours of one described encoding in another: any white point, primaries and transfer function, gray included.

An encoding is a name such as RGB_D65_SRG_Rel_Lin, or a row of numbers of its own, as files bring them. Each distinct
one gives a *profile*: the matrix of its linear light to XYZ as it is, the same adapted to the D50 white of the
connection space, and both inverses. Profiles are formed once per encoding, not per pixel; pixels are joined with
those of their source and their target, and all that is done per pixel is arithmetic on columns. How many encodings there
are isn't bounded, so that no side is broadcast by force.

Values run from 0 to 1 and aren't clamped; transfer functions are mirrored below 0, so that colours that the target can't
show come back unharmed. Gray is the luminance of the connection space, and as a source the neutral of that luminance.
The target's intent decides on the white: under Abs colours stay as measured, under all others white becomes white.
An encoding that isn't well formed, or whose primaries lie on a line, gives null colours; so does a null name or value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import color, names
from tessella.storage import materialize

# Responses of cones to XYZ in which one white is adapted to another (Bradford).
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
#: White of the connection space.
CONNECTION_WHITE = names.WHITE_POINTS["D50"]

Matrix = Sequence[Sequence[Column]]


def _constant(m: Sequence[Sequence[float]]) -> Matrix:
    return [[F.lit(float(v)) for v in row] for row in m]


def _read(array: str | Column) -> Matrix:
    """The matrix in an array of nine numbers."""
    return [[F.get(array, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]


def _held(values: Sequence[Column]) -> Column:
    """An array that is computed once: of a plain one the optimiser puts each element's whole expression wherever it is read."""
    return F.transform(F.array(*values), lambda v: v + 0.0)


def _array(m: Matrix) -> Column:
    return _held([v for row in m for v in row])


def _times(a: Matrix, b: Matrix) -> Matrix:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def _apply(a: Matrix, v: Sequence[Column]) -> list[Column]:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in a]


def _inverse(column: str) -> Matrix:
    """Inverse of the matrix in an array, by cofactors; null if it has none."""
    m = _read(column)
    cofactor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = m[0][0] * cofactor(0, 0) + m[0][1] * cofactor(0, 1) + m[0][2] * cofactor(0, 2)
    return [[cofactor(j, i) / F.when(F.abs(det) > 1e-12, det) for j in range(3)] for i in range(3)]


def _xyz(x: Column, y: Column) -> list[Column]:
    """XYZ of a chromaticity with Y = 1."""
    seen = F.when(y != 0, y)
    return [x / seen, F.lit(1.0), (1 - x - y) / seen]


def named(encodings: DataFrame) -> DataFrame:
    """(name, white, primaries, transfer, gamma, absolute, gray) of the distinct names in column `name`; ill-formed ones have no numbers."""
    table = lambda known, key: F.element_at(F.create_map(*[F.lit(x) for name, v in known.items() for x in (name, list(v))]), key)
    told = encodings.select("name").where("name is not null").distinct().withColumn("d", names.parse_description(F.col("name")))
    gray = F.col("d.space") == "Gra"
    return told.select(
        "name",
        F.when(F.col("d.ok"), table(names.WHITE_POINTS, F.col("d.white"))).alias("white"),
        F.when(F.col("d.ok") & ~gray, table(names.PRIMARIES, F.col("d.primaries"))).alias("primaries"),
        F.when(F.col("d.transfer").isin(*names.TRANSFERS), F.col("d.transfer")).alias("transfer"),
        F.col("d.gamma").alias("gamma"),
        (F.col("d.intent") == "Abs").alias("absolute"),
        gray.alias("gray"),
    )


def profiles(encodings: DataFrame) -> DataFrame:
    """(name, gray, transfer, gamma, absolute, own, own_back, adapted, adapted_back): matrices are arrays of nine numbers, by rows.

    encodings: name, white (x, y), primaries (six numbers), transfer, gamma (where transfer is null), absolute, gray. Each name once.
    """
    white = _xyz(F.get("white", F.lit(0)), F.get("white", F.lit(1)))
    corner = [_xyz(F.get("primaries", F.lit(2 * k)), F.get("primaries", F.lit(2 * k + 1))) for k in range(3)]
    kept = encodings.withColumn("w", _held(white)).withColumn("p", _array([[corner[j][i] for j in range(3)] for i in range(3)]))
    kept = kept.withColumn("q", _array(_inverse("p")))
    w = [F.get("w", F.lit(k)) for k in range(3)]
    light = _apply(_read("q"), w)
    p = _read("p")
    # equal parts of gray's three channels are its white
    colour = _array([[p[i][j] * light[j] for j in range(3)] for i in range(3)])
    kept = kept.withColumn("own", F.when(F.col("gray"), _array([[w[i] / 3] * 3 for i in range(3)])).otherwise(colour))
    target = _apply(_constant(BRADFORD), [F.lit(v) for v in (CONNECTION_WHITE[0] / CONNECTION_WHITE[1], 1.0, (1 - sum(CONNECTION_WHITE)) / CONNECTION_WHITE[1])])
    cones = _apply(_constant(BRADFORD), w)
    gain = [[target[i] / cones[i] * BRADFORD[i][j] for j in range(3)] for i in range(3)]
    kept = kept.withColumn("adapt", _array(_times(_constant(color.inverse3(BRADFORD)), gain)))
    kept = kept.withColumn("adapted", _array(_times(_read("adapt"), _read("own"))))
    luminance = F.array(*[F.lit(v) for v in (0.0, 1.0, 0.0) * 3])
    back = lambda m: F.when(F.col("gray"), F.when(F.col("white").isNotNull(), luminance)).otherwise(_array(_inverse(m))).alias(f"{m}_back")
    return kept.select("name", "gray", "transfer", "gamma", "absolute", "own", back("own"), "adapted", back("adapted"))


def _transfer(v: Column, transfer: Column, gamma: Column, decode: bool) -> Column:
    """A signal as linear light, or the reverse; mirrored below 0."""
    size = F.abs(v)
    if decode:
        srgb = F.when(size <= color.SRGB_KNEE / 255, size / 12.92).otherwise(F.pow((size + 0.055) / 1.055, F.lit(2.4)))
        of = {"SRG": srgb, "PeQ": color.pq_decode(size), "HLG": color.hlg_decode(size)}
        power = F.pow(size, 1 / gamma)
    else:
        srgb = F.when(size <= color.SRGB_KNEE / 255 / 12.92, size * 12.92).otherwise(1.055 * F.pow(size, F.lit(1 / 2.4)) - 0.055)
        of = {"SRG": srgb, "PeQ": F.when(size > 0, color.pq_encode(size)).otherwise(0.0), "HLG": color.hlg_encode(size)}
        power = F.pow(size, gamma)
    out = F.when(transfer == "Lin", size)
    for name, curve in of.items():
        out = out.when(transfer == name, curve)
    return F.signum(v) * out.when(transfer.isNull() & (gamma > 0), power)


def convert(pixels: DataFrame, channels: Sequence[str] = ("r", "g", "b"), source: str = "source", target: str = "target", encodings: DataFrame | None = None) -> DataFrame:
    """pixels with its channels, in the encoding that column `source` names, turned into the one that `target` names.

    Without `encodings` (as `profiles` takes them) both columns hold descriptions that `named` reads. Gray pixels have the same value in
    all channels. Other columns stay; rows are neither added nor dropped.
    """
    if encodings is None:
        encodings = named(pixels.select(F.explode(F.array(source, target)).alias("name")))
    made = materialize(profiles(encodings), "profiles")  # a row per encoding, read twice
    # one struct per side, so that no column of pixels can clash with a profile's
    free = next(n for n in ("profile" + "_" * k for k in range(len(pixels.columns) + 1)) if not any(n.lower() in c.lower() for c in pixels.columns))
    end = lambda side: made.select(F.struct(*made.columns).alias(f"{free}{side}"))
    joined = pixels.join(end(1), F.col(source) == F.col(f"{free}1.name"), "left").join(end(2), F.col(target) == F.col(f"{free}2.name"), "left")
    field = lambda side, name: F.col(f"{free}{side}.{name}")
    lit = joined.withColumn(f"{free}3", F.transform(F.array(*channels), lambda v: _transfer(v, field(1, "transfer"), field(1, "gamma"), True)))
    step = lambda frame, at, to, side, way: frame.withColumn(to, _held(_apply(_read(F.when(field(2, "absolute"), field(side, f"own{way}")).otherwise(field(side, f"adapted{way}"))), [F.get(at, F.lit(k)) for k in range(3)])))
    seen = step(step(lit, f"{free}3", f"{free}4", 1, ""), f"{free}4", f"{free}5", 2, "_back")
    coded = seen.withColumn(f"{free}6", F.transform(f"{free}5", lambda v: _transfer(v, field(2, "transfer"), field(2, "gamma"), False)))
    shown = {c: F.get(f"{free}6", F.lit(k)) for k, c in enumerate(channels)}
    return coded.select(*[shown[c].alias(c) if c in shown else F.col(f"`{c}`") for c in pixels.columns])
