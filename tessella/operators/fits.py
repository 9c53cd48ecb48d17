"""Lines with knots at equal distances, fitted to points by least squares, however many points a series has.

Each point adds to the two knots beside it. Their sums are all that the fit needs, one row per (series, knot), which partial
aggregation makes before anything is shuffled. The equations link a knot to the next one only, so a series is solved
by one pass up and one down its knots, inside its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.grid import KEY

#: Added to each knot's own sum: keeps knots at 0 that no point speaks of, and moves others by less than a billionth.
RIDGE = 1e-9


def _sums(points: DataFrame, keys: Sequence[str], place: Column, value: Column) -> DataFrame:
    """(keys, knot, own, next, v): sums of squared shares, of products with the next knot's, and of shares times values."""
    i = F.floor(place)
    share = place - i
    first = F.struct(i.alias("knot"), ((1 - share) * (1 - share)).alias("own"), ((1 - share) * share).alias("next"), ((1 - share) * value).alias("v"))
    second = F.when(share > 0, F.struct((i + 1).alias("knot"), (share * share).alias("own"), F.lit(0.0).alias("next"), (share * value).alias("v")))
    parts = points.where((place >= 0) & value.isNotNull()).select(*keys, F.explode(F.array_compact(F.array(first, second))).alias("_t"))
    return parts.groupBy(*keys, F.col("_t.knot").alias("knot")).agg(*[F.sum(f"_t.{c}").alias(c) for c in ("own", "next", "v")])


def _solved(knots: Column) -> Column:
    """Heights of knots 0, 1, 2, ... from their sums in order."""
    none = F.array().cast("array<struct<c:double,d:double>>")

    def up(s: Column, k: Column) -> Column:
        pivot = k["own"] + RIDGE - s["link"] * s["c"]
        c, d = k["next"] / pivot, (k["v"] - s["link"] * s["d"]) / pivot
        return F.struct(c.alias("c"), d.alias("d"), k["next"].alias("link"), F.concat(s["out"], F.array(F.struct(c.alias("c"), d.alias("d")))).alias("out"))

    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("d"), F.lit(0.0).alias("link"), none.alias("out"))
    passed = F.aggregate(knots, start, up, lambda s: F.reverse(s["out"]))

    def down(xs: Column, k: Column) -> Column:
        return F.concat(F.array(k["d"] - k["c"] * F.coalesce(F.get(xs, F.lit(0)), F.lit(0.0))), xs)

    return F.aggregate(passed, F.array().cast("array<double>"), down)


def knot_fit(points: DataFrame, keys: Sequence[str], place: str, value: str, step: float, exclude: float | None = None) -> DataFrame:
    """(keys, heights): for each series the heights at places 0, step, 2 * step, ... up to the knot after its last point.

    Points whose value is null or equals exclude, or whose place is null or negative, are left out; a series of such points has
    no row. A knot that no point is near has a null height. Keys may be null; the number of knots of a series is bounded by its last place.
    """
    v = F.col(value).cast("double")
    if exclude is not None:
        v = F.when(v != exclude, v)
    sums = _sums(points, keys, F.col(place) / F.lit(float(step)), v)
    zero = F.struct(F.lit(0.0).alias("own"), F.lit(0.0).alias("next"), F.lit(0.0).alias("v"))
    rows = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("knot", F.struct("own", "next", "v").alias("s")))).alias("_m"), F.max("knot").alias("_last"))
    rows = rows.withColumn("_knots", F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last")), lambda k: F.coalesce(F.col("_m")[k], zero)))
    return rows.select(*keys, F.zip_with(_solved(F.col("_knots")), "_knots", lambda h, k: F.when(k["own"] > 0, h)).alias("heights"))


def height_at(heights: Column, place: Column, step: float) -> Column:
    """The fitted line's value at a place; null beyond its knots."""
    at = place / F.lit(float(step))
    i, share = F.floor(at).cast("int"), at - F.floor(at)
    return F.get(heights, i) * (1 - share) + F.when(share > 0, F.get(heights, i + 1) * share).otherwise(0.0)


def plane_knots(pixels: DataFrame, step: int, exclude: float | None = None) -> DataFrame:
    """(image_id, c, y, x, v): heights at every step-th cell of a grid: rows are fitted first, then their knots along columns."""
    along = knot_fit(pixels, ["image_id", "c", "y"], "x", "v", step, exclude)
    columns = along.select("image_id", "c", "y", F.posexplode("heights").alias("x", "v"))
    down = knot_fit(columns, ["image_id", "c", "x"], "y", "v", step)
    return down.select("image_id", "c", "x", F.posexplode("heights").alias("y", "v")).select(*KEY, "v")
