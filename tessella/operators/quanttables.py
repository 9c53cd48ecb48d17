"""Descriptions of quantisation tables: few parameters in a few bytes, the 64 weights they stand for, and which one suits a tile.

A description is a kind and its parameters, kept in 64ths of a whole so that writing it loses nothing more. It is one row, and
everything about it is an expression inside the row. The choice among candidates, a parameter of the operator and so
bounded, prices each block under every candidate where the block is; only a tile's sums, one per candidate, are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.codes import pack_signed, varlen_bits
from tessella.functions.lanes import let

#: Kinds: weights that change by equal ratios between bands of distance, one per octave of the larger frequency, or all 64.
BANDS, OCTAVES, RAW = 0, 1, 2
#: Parameters are whole multiples of 1 / UNIT, in two bytes.
UNIT = 64
#: Distance of the highest frequency, a little more than it is, so that it lies below the last band.
FARTHEST = math.sqrt(2) + 1e-6
#: Smallest weight that a table gives.
LEAST_WEIGHT = 1 / UNIT


def whole(parameters: Column) -> Column:
    """Parameters in units, held within two bytes."""
    return F.transform(parameters, lambda p: F.least(F.greatest(F.floor(p * UNIT + 0.5), F.lit(-32768)), F.lit(32767)).cast("long"))


def table_bytes(kind: Column, parameters: Column) -> Column:
    """A description as bytes: kind, number of parameters, and each in two bytes, low one first."""
    hexes = F.transform(whole(parameters), lambda p: F.format_string("%02x%02x", F.pmod(p, F.lit(256)), F.pmod(F.floor(p / 256), F.lit(256))))
    return F.unhex(F.concat(F.format_string("%02x%02x", kind.cast("long"), F.size(parameters).cast("long")), F.array_join(hexes, "")))


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long")


def read_table(data: Column) -> Column:
    """(kind, parameters) of table_bytes; null where bytes are missing or left over, or the kind is unknown."""
    n = _byte(data, F.lit(2))

    def value(i: Column) -> Column:
        v = _byte(data, 2 * i + 3) + 256 * _byte(data, 2 * i + 4)
        return F.when(v >= 32768, v - 65536).otherwise(v) / F.lit(float(UNIT))

    parameters = F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), value))
    sound = (F.octet_length(data) >= 2) & (F.octet_length(data) == 2 + 2 * n) & (_byte(data, F.lit(1)) <= RAW)
    return F.when(sound, F.struct(_byte(data, F.lit(1)).alias("kind"), parameters.alias("parameters")))


def band_values(parameters: Column) -> Column:
    """The bands' weights: the first parameter, and each next one larger by a share of itself, or smaller where that is negative."""
    ratio = lambda p: F.when(p > 0, 1 + p).otherwise(1 / (1 - p))
    return F.aggregate(F.slice(parameters, 2, 64), F.array(F.get(parameters, F.lit(0))), lambda xs, p: F.concat(xs, F.array(F.element_at(xs, -1) * ratio(p))))


def weights(kind: Column, parameters: Column) -> Column:
    """64 weights in row-major order; null for a description with too few parameters (1, 4 and 64 by kind), or whose first band isn't above 0."""
    distance = F.array(*[F.lit(math.sqrt((i % 8) ** 2 + (i // 8) ** 2) / 7.0) for i in range(64)])
    octave = F.array(*[F.lit(max(i % 8, i // 8).bit_length()) for i in range(64)])

    def bands(b: Column) -> Column:
        def one(d: Column) -> Column:
            pos = d * (F.size(b) - 1) / F.lit(FARTHEST)
            k = F.floor(pos).cast("int")
            return F.get(b, k) * F.pow(F.coalesce(F.get(b, k + 1), F.get(b, k)) / F.get(b, k), pos - k)

        return F.transform(distance, one)

    least = lambda w: F.transform(w, lambda x: F.greatest(x, F.lit(LEAST_WEIGHT)))
    size = F.size(parameters)
    return least(
        F.when((kind == BANDS) & (size >= 1) & (F.get(parameters, F.lit(0)) > 0), let(band_values(parameters), bands))
        .when((kind == OCTAVES) & (size >= 4), F.transform(octave, lambda o: F.get(parameters, o)))
        .when((kind == RAW) & (size >= 64), F.slice(parameters, 1, 64))
    )


def priced(coefficients: Column, table: Column, per_error: float) -> Column:
    """What a block costs under a table: bits of its numbers, and per_error for each unit of squared error."""

    def one(v: Column, w: Column) -> Column:
        q = F.signum(v) * F.floor(F.abs(v) * w + 0.5)
        error = v - q / w
        return F.when(q == 0, 0.0).otherwise(2.0 * varlen_bits(pack_signed(q.cast("long"))) + 1) + per_error * error * error

    return F.aggregate(F.zip_with(coefficients, table, one), F.lit(0.0), lambda s, x: s + x)


def best_tables(blocks: DataFrame, keys: Sequence[str], coefficients: str, candidates: Sequence[tuple[int, Sequence[float]]], per_error: float) -> DataFrame:
    """(keys, choice, cost): for each tile, named by its keys, the candidate that its blocks cost least under; the first of equals.

    candidates are (kind, parameters) as they come from their bytes. Without blocks there are no rows; a null
    block costs nothing.
    """
    spark = blocks.sparkSession
    described = spark.createDataFrame([(n, kind, [float(p) for p in parameters]) for n, (kind, parameters) in enumerate(candidates)], "n int, kind int, parameters array<double>")
    known = described.select("n", weights(F.col("kind"), F.col("parameters")).alias("w")).collect()  # one row per candidate, a parameter
    tables = [r["w"] for r in sorted(known, key=lambda r: r["n"])]
    if any(t is None for t in tables):
        raise ValueError("a candidate has too few parameters")
    v = F.col(coefficients)
    rows = blocks.select(*keys, F.array(*[priced(v, F.array(*map(F.lit, t)), per_error) for t in tables]).alias("_costs"))
    sums = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(F.get("_costs", F.lit(k))), F.lit(0.0)).alias(f"_cost{k}") for k in range(len(tables))])
    best = F.array_min(F.array(*[F.struct(F.col(f"_cost{k}").alias("cost"), F.lit(k).alias("choice")) for k in range(len(tables))]))
    return sums.withColumn("_best", best).select(*keys, F.col("_best.choice").alias("choice"), F.col("_best.cost").alias("cost"))


def field_bytes(choices: Column) -> Column:
    """The choices of an image's tiles, in order, as runs: a byte of how many less 1 and a byte of which, as hexadecimal."""
    start = F.struct(F.lit(-1).cast("long").alias("value"), F.lit(0).cast("long").alias("n"), F.lit("").alias("out"))
    flush = lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.format_string("%02x%02x", s["n"] - 1, s["value"]))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        x = x.cast("long")
        same = (s["value"] == x) & (s["n"] < 256)
        return F.struct(x.alias("value"), F.when(same, s["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), F.when(same, s["out"]).otherwise(flush(s)).alias("out"))

    return F.aggregate(choices, start, step, flush)


def read_field(code: Column) -> Column:
    """Choices from field_bytes."""
    n = F.length(code) / 4
    number = lambda at: F.conv(F.substring(code, at, F.lit(2)), 16, 10).cast("int")
    runs = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.array_repeat(number(4 * i + 3).cast("long"), number(4 * i + 1) + 1))
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.flatten(runs))
