"""Symbols of quantised fields and blocks, with the contexts they are coded under.

A block's tokens are made inside its row; predictions from neighbours are windows over a row or a column of
blocks. Histograms are one aggregate per (context, symbol).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.codes import pack_signed
from tessella.functions.lanes import let

#: Residuals from here on are escaped.
ESCAPE = 255
#: Value that is predicted where there is no neighbour.
NO_NEIGHBOUR = 32


def from_top_and_left(top: Column, left: Column, default: int = NO_NEIGHBOUR) -> Column:
    """Mean of both neighbours rounded up, the one there is, or a default."""
    return F.when(top.isNotNull() & left.isNotNull(), F.floor((top + left + 1) / 2)).otherwise(F.coalesce(top, left, F.lit(default))).cast("long")


def neighbours(field: DataFrame, value: str, image: str = "image_id") -> DataFrame:
    """field (image, by, bx, value) with the values above and to the left."""
    return field.withColumn("top", F.lag(value).over(Window.partitionBy(image, "bx").orderBy("by"))).withColumn("left", F.lag(value).over(Window.partitionBy(image, "by").orderBy("bx")))


def field_tokens(field: DataFrame, value: str, image: str = "image_id") -> DataFrame:
    """(image, by, bx, token, extra): packed residuals of a quantisation field; an escaped one carries the value less 1."""
    v = F.col(value)
    packed = neighbours(field, value, image).withColumn("packed", pack_signed(v - from_top_and_left(F.col("top"), F.col("left"))))
    return packed.select(image, "by", "bx", F.least(F.col("packed"), F.lit(ESCAPE)).cast("long").alias("token"), F.when(F.col("packed") >= ESCAPE, v - 1).cast("long").alias("extra"))


def strategy_tokens(field: DataFrame, strategy: str, first: Column) -> DataFrame:
    """Strategies of the blocks that begin one; the other blocks of a large one have no token."""
    return field.where(first).withColumn("token", F.col(strategy).cast("long"))


def scanned(block: Column, order: list[int]) -> Column:
    """A block's values in scan order."""
    return let(block, lambda b: F.array(*[F.get(b, F.lit(i)) for i in order]))


def coefficient_tokens(values: Column) -> Column:
    """Tokens of a block's values in scan order, without the first: an array of (place, run, value, left).

    run is how many zeros come before, value is packed, and left how many values other than 0 are yet to come, this one
    included; with its place that is the token's context.
    """
    placed = F.transform(values, lambda v, i: F.struct(i.alias("place"), pack_signed(v.cast("long")).alias("value")))
    some = F.filter(placed, lambda x: (x["value"] != 0) & (x["place"] > 0))
    run = lambda xs, x, i: x["place"] - F.coalesce(F.get(xs, i - 1)["place"], F.lit(0)) - 1
    return let(some, lambda xs: F.transform(xs, lambda x, i: F.struct(x["place"].alias("place"), run(xs, x, i).alias("run"), x["value"].alias("value"), (F.size(xs) - i).alias("left"))))


def token_context(left: Column, place: Column) -> Column:
    """One of 64 contexts: how many values are left and how far the scan is, each by its logarithm."""
    return (F.least(F.floor(F.log2(left)), F.lit(7)) * 8 + F.least(F.floor(F.log2(place)), F.lit(7))).cast("long")


def context_histograms(symbols: DataFrame, context: str, symbol: str) -> DataFrame:
    return symbols.groupBy(context, symbol).agg(F.count(F.lit(1)).alias("n"))


def context_bits(histograms: DataFrame, context: str) -> DataFrame:
    """(context, n, bits): symbols of a context and the bits that an ideal code of its own takes for them."""
    total = F.sum("n")
    return histograms.groupBy(context).agg(total.alias("n"), (total * F.log2(total) - F.sum(F.col("n") * F.log2("n"))).alias("bits"))


def static_context(context: Column, clusters: int = 8) -> Column:
    """Fixed clusters of contexts, by how many values are left."""
    return F.least(F.floor(context / 8), F.lit(clusters - 1)).cast("long")


def move_to_front(symbols: Column) -> Column:
    """Places of symbols in a list 0, 1, 2, ... to whose front each one moves: those that came since a symbol was last met,
    or for a new one its number and those before it that are larger."""

    def place(x: Column, i: Column) -> Column:
        before = F.slice(symbols, 1, i)
        since = F.array_position(F.reverse(before), x)
        seen = F.array_distinct(before)
        return F.when(since > 0, F.size(F.array_distinct(F.slice(F.reverse(before), 1, F.greatest(since - 1, F.lit(0)).cast("int"))))).otherwise(x + F.size(F.filter(seen, lambda s: s > x))).cast("long")

    return F.transform(symbols, place)


def zero_runs(values: Column) -> Column:
    """Runs of equal values as (value, length), in order."""
    starts = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("at"), x.alias("value"), F.coalesce(x == F.get(values, i - 1), F.lit(False)).alias("same"))), lambda s: ~s["same"])
    return let(starts, lambda xs: F.transform(xs, lambda s, i: F.struct(s["value"].alias("value"), (F.coalesce(F.get(xs, i + 1)["at"], F.size(values)) - s["at"]).alias("length"))))


def from_front(places: Column, symbols: int) -> Column:
    """Inverse of move_to_front for numbers below `symbols`."""
    start = F.struct(F.sequence(F.lit(0), F.lit(symbols - 1)).cast("array<bigint>").alias("list"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, place: Column) -> Column:
        at = place.cast("int")
        x = F.get(s["list"], at)
        rest = F.concat(F.slice(s["list"], 1, at), F.slice(s["list"], at + 2, symbols))
        return F.struct(F.concat(F.array(x), rest).alias("list"), F.concat(s["out"], F.array(x)).alias("out"))

    return F.aggregate(places, start, step, lambda s: s["out"])


def from_runs(runs: Column) -> Column:
    """Inverse of zero_runs."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["length"].cast("int"))))
