"""Names and texts: descriptions of colour encodings, chromaticities, gammas, paths and formats, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chromaticities (x, y) of the named white points.
WHITE_POINTS = {"D65": (0.3127, 0.3290), "D60": (0.32168, 0.33767), "D50": (0.3457, 0.3585), "EER": (1 / 3, 1 / 3)}
# Chromaticities of the named primaries, red x, y, green x, y, blue x, y.
PRIMARIES = {
    "SRG": (0.64, 0.33, 0.30, 0.60, 0.15, 0.06),
    "202": (0.708, 0.292, 0.170, 0.797, 0.131, 0.046),
    "DCI": (0.680, 0.320, 0.265, 0.690, 0.150, 0.060),
    "AP0": (0.7347, 0.2653, 0.0000, 1.0000, 0.0001, -0.077),
    "AP1": (0.713, 0.293, 0.165, 0.830, 0.128, 0.044),
    "Ado": (0.64, 0.33, 0.21, 0.71, 0.15, 0.06),
}
#: How far a chromaticity or gamma may be from a named one.
NEAR = 1e-3
# Exponents by which named transfer functions are told.
GAMMAS = {"Lin": 1.0, "SRG": 1 / 2.2, "Ado": 256 / 563}
SPACES, INTENTS, TRANSFERS = ("RGB", "Gra"), ("Per", "Rel", "Sat", "Abs"), ("SRG", "Lin", "PeQ", "HLG")


def parse_description(name: Column) -> Column:
    """Fields of a description such as RGB_D65_SRG_Rel_Lin; gray ones have no primaries. `ok` tells whether it is well formed.

    A transfer function is a name, or g with an exponent of 0 to 1.
    """
    parts = F.split(name, "_")
    space, gray = F.get(parts, F.lit(0)), F.get(parts, F.lit(0)) == "Gra"
    at = lambda i: F.get(parts, F.when(gray, F.lit(i - 1)).otherwise(F.lit(i)))
    white, primaries, intent, transfer = F.get(parts, F.lit(1)), F.when(~gray, F.get(parts, F.lit(2))), at(3), at(4)
    gamma = gamma_from_text(transfer)
    known = lambda x, names: F.coalesce(x.isin(*names), F.lit(False))
    ok = (
        known(space, SPACES) & known(white, WHITE_POINTS) & (gray | known(primaries, PRIMARIES)) & known(intent, INTENTS)
        & (known(transfer, TRANSFERS) | F.coalesce(gamma.between(0.0, 1.0), F.lit(False))) & (F.size(parts) == F.when(gray, 4).otherwise(5))
    )
    return F.struct(space.alias("space"), white.alias("white"), primaries.alias("primaries"), intent.alias("intent"), transfer.alias("transfer"), gamma.alias("gamma"), ok.alias("ok"))


def gamma_from_text(text: Column) -> Column:
    """The exponent of `g0.4545455` or of a named transfer function; null for anything else."""
    named = F.lit(None).cast("double")
    for name, value in GAMMAS.items():
        named = F.when(text == name, F.lit(value)).otherwise(named)
    return F.when(text.rlike("^g[0-9]+(\\.[0-9]+)?$"), F.substring(text, 2, 20).try_cast("double")).otherwise(named)


def text_from_gamma(gamma: Column) -> Column:
    """The name of a transfer function that is near, else g and seven places."""
    out = F.concat(F.lit("g"), F.format_string("%.7f", gamma))
    for name, value in reversed(GAMMAS.items()):
        out = F.when(F.abs(gamma - value) < NEAR, F.lit(name)).otherwise(out)
    return out


def transfer_from_gamma(gamma: Column) -> Column:
    out = F.lit("?")
    for name, value in reversed(GAMMAS.items()):
        out = F.when(F.abs(gamma - value) < NEAR, F.lit(name)).otherwise(out)
    return out


def chromaticity(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """CIE x and y of a tristimulus value; black has the chromaticity 0, 0."""
    total = x + y + z
    return tuple(F.when(total != 0, v / total).otherwise(0.0) for v in (x, y))


def _nearest(values: list[Column], named: dict[str, tuple[float, ...]]) -> Column:
    out = F.lit("?")
    for name, fixed in reversed(named.items()):
        close = F.lit(True)
        for v, x in zip(values, fixed, strict=True):
            close = close & (F.abs(v - x) < NEAR)
        out = F.when(close, F.lit(name)).otherwise(out)
    return out


def white_point(x: Column, y: Column) -> Column:
    """The name of the white point that is near, or ?."""
    return _nearest([x, y], WHITE_POINTS)


def primaries(values: list[Column]) -> Column:
    """The name of the primaries whose six chromaticities are near, or ?."""
    return _nearest(values, PRIMARIES)


def join_path(first: Column, second: Column) -> Column:
    """Two parts of a path with one slash between them; an empty part adds none."""
    return F.when((first == "") | (second == ""), F.concat(first, second)).otherwise(F.concat(F.rtrim(first, F.lit("/")), F.lit("/"), F.ltrim(second, F.lit("/"))))


def format_float(value: Column, width: int, places: int) -> Column:
    """A number with so many places, padded on the left."""
    text = F.format_string(f"%.{places}f", value)
    return F.lpad(text, width, " ")


def starts_with_magic(data: Column, magic: bytes) -> Column:
    return F.substring(data, 1, len(magic)) == F.lit(magic)


def colour_hint(hints: Column, default: str) -> Column:
    """The encoding that the key color_space of a map of hints names; other keys are ignored."""
    return F.coalesce(F.element_at(hints, "color_space"), F.lit(default))
