"""Counters of runs: sizes by layer, clamps, filters, correlations, elapsed times. Each is one aggregate whose partial
sums merge, so that counters of any parts of a corpus add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.stats import medians


def layer_sizes(rows: DataFrame, layer: str, size: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, layer, n, size, share): sizes by layer and their share of the whole."""
    sums = rows.groupBy(*by, layer).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    whole = sums.groupBy(*by).agg(F.sum("size").alias("whole")) if by else sums.agg(F.sum("size").alias("whole"))
    joined = sums.join(whole, list(by)) if by else sums.crossJoin(F.broadcast(whole))  # one row
    return joined.select(*by, layer, "n", "size", (F.col("size") / F.col("whole")).alias("share"))


def counters(rows: DataFrame, by: Sequence[str], **values: Column) -> DataFrame:
    """Sums of all named values."""
    return rows.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in values.items()])


def clamp_counts(rows: DataFrame, original: Column, corrected: Column, interval: Column, by: Sequence[str]) -> DataFrame:
    """How many corrections were cut to half an interval, on either side, of how many."""
    moved = corrected - original
    return counters(rows, by, n=F.lit(1), low=(moved < -0.5 * interval).cast("int"), high=(moved > 0.5 * interval).cast("int"))


def correlation_sums(rows: DataFrame, x: Column, y: Column, factor: Column, by: Sequence[str]) -> DataFrame:
    """Absolute sums of x before and after factor * y is taken off it, and the sums of both squares and the product."""
    return counters(rows, by, before=F.abs(x), after=F.abs(x - factor * y), xx=x * x, yy=y * y, xy=x * y)


def forgetting_slope(rows: DataFrame, x: str, y: str, order: str, by: Sequence[str], keep: float = 0.9) -> DataFrame:
    """Slope of x on y through the origin at each row, from sums in which what is k rows older weighs keep^k.

    The weights are relative to the row, so each sum is one running sum of scaled values, kept in range by blocks of 64 rows:
    what lies two blocks back weighs keep^64 at most and is left out.
    """
    w = Window.partitionBy(*by).orderBy(order)
    placed = rows.withColumn("_i", F.row_number().over(w) - 1)
    weight = lambda i: F.pow(F.lit(keep), i)
    last = w.rowsBetween(-63, 0)
    pairs = F.collect_list(F.struct(F.col("_i").alias("i"), (F.col(x) * F.col(y)).alias("xy"), (F.col(y) * F.col(y)).alias("yy"))).over(last)
    at = placed.withColumn("_w", pairs)
    fold = lambda name: F.aggregate("_w", F.lit(0.0), lambda s, p: s + p[name] * weight(F.col("_i") - p["i"]))
    return at.withColumn("slope", F.when(fold("yy") > 0, fold("xy") / fold("yy")).otherwise(0.0)).drop("_i", "_w")


def elapsed_summary(rows: DataFrame, by: str, order: str, seconds: str) -> DataFrame:
    """(by, n, seconds, spread): of one repetition itself, of two the second, of up to five the geometric mean without the
    first, of more the median with its absolute deviation."""
    w = Window.partitionBy(by).orderBy(order)
    ranked = rows.withColumn("_i", F.row_number().over(w))
    late = F.when(F.col("_i") > 1, F.log(seconds))
    few = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_i") == 1, F.col(seconds))).alias("first"), F.max(F.when(F.col("_i") == 2, F.col(seconds))).alias("second"), F.exp(F.avg(late)).alias("mean"))
    many = medians(rows, seconds, [by]).select(by, F.col("median").alias("_median"), F.col("mad").alias("_mad"))
    n = F.col("n")
    value = F.when(n == 1, F.col("first")).when(n == 2, F.col("second")).when(n <= 5, F.col("mean")).otherwise(F.col("_median"))
    return few.join(many, by).select(by, "n", value.alias("seconds"), F.when(n > 5, F.col("_mad")).otherwise(0.0).alias("spread"))


def quartile_range(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg((F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"))


def not_numbers(rows: DataFrame, value: Column) -> DataFrame:
    """How many values aren't numbers."""
    return rows.agg(F.count_if(F.isnan(value)).alias("bad"), F.count(F.lit(1)).alias("n"))
