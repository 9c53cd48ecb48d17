"""Moments, order statistics and robust fits as mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def power_sums(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, extremes and sums of powers: partials that merge by addition."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), *[F.sum(F.pow(v, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)])


def merge_power_sums(partials: DataFrame, by: Sequence[str]) -> DataFrame:
    return partials.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2, 3, 4)])


def moments(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """n, extremes, mean, both variances, skewness and kurtosis (not excess), biased and corrected.

    A single value has variance 0, and values without spread have skewness and kurtosis 0.
    """
    v = F.col(value).cast("double")
    g = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"), F.var_samp(v).alias("vs"), F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku")
    )
    n, flat = F.col("n"), F.abs(F.col("var_pop") * F.col("n")) < 1e-7
    shrink = (n - 1) / n
    skew, kurt = F.when(flat, 0.0).otherwise(F.col("sk")), F.when(flat, 0.0).otherwise(F.col("ku") + 3)
    return g.select(*by, "n", "low", "high", "mean", "var_pop", F.when(n == 1, 0.0).otherwise(F.col("vs")).alias("variance"), skew.alias("skewness"), (skew * F.pow(shrink, 1.5)).alias("skewness_corrected"), kurt.alias("kurtosis"), (kurt * F.pow(shrink, 2)).alias("kurtosis_corrected"))


def geometric_mean(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Of positive values, 0 if there are none; summed in logarithms, so that it can't overflow."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.coalesce(F.exp(F.avg(F.when(v > 0, F.log(v)))), F.lit(0.0)).alias("geometric_mean"))


def medians(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Median and median absolute deviation: one aggregate each, the first joined back as one row per group."""
    m = df.groupBy(*by).agg(F.median(value).alias("median"))
    spread = df.join(m, list(by)) if by else df.crossJoin(F.broadcast(m))
    return spread.groupBy(*by, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def integer_median(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Median of integers; the mean of the two middle values rounds up. From counts of distinct values, never from all rows of a group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    running = counts.withColumn("upto", F.expr(f"sum(k) over (partition by {', '.join(by) or '1'} order by {value})")).withColumn("n", F.expr(f"sum(k) over (partition by {', '.join(by) or '1'})"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    a = F.min(F.when(F.col("upto") >= low, F.col(value)))
    b = F.min(F.when(F.col("upto") >= high, F.col(value)))
    return running.groupBy(*by).agg(F.floor((a + b + 1) / 2).cast("long").alias("median"))


def counting_sort(df: DataFrame, value: str) -> DataFrame:
    """(value, count) in order: sorting by counting distinct values; `repeat` brings the rows back."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(value)


def repeat(counted: DataFrame, value: str) -> DataFrame:
    return counted.select(F.explode(F.array_repeat(value, F.col("n").cast("int"))).alias(value))


def floor_quantile(df: DataFrame, value: str, p: float, by: Sequence[str]) -> DataFrame:
    """sorted[floor(p n)] of each group, from running counts of distinct values."""
    keys = ", ".join(by) or "1"
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    running = counts.withColumn("upto", F.expr(f"sum(k) over (partition by {keys} order by {value})")).withColumn("n", F.expr(f"sum(k) over (partition by {keys})"))
    return running.groupBy(*by).agg(F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1), F.col(value))).alias("quantile"))


def siegel_line(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repeated-median line through points (by..., x, y) with distinct x: slope and intercept per group.

    All pairs of a group are what the estimator is defined on; it is for groups of a few thousand
    points, which a caller gets by aggregating first.
    """
    other = points.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = points.join(other, list(by)).where("x != x2")
    slopes = pairs.groupBy(*by, "x").agg(F.median((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("s"))
    slope = slopes.groupBy(*by).agg(F.median("s").alias("slope"))
    return points.join(slope, list(by)).groupBy(*by, "slope").agg(F.median(F.col("y") - F.col("slope") * F.col("x")).alias("intercept"))


def line_quality(points: DataFrame, lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest and median absolute residual of each group's line."""
    residual = F.abs(F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept")))
    return points.join(lines, list(by)).groupBy(*by).agg(F.max(residual).alias("max_l1"), F.median(residual).alias("median_l1"))


def least_squares(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def through_origin(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """sum(xy) / sum(xx), 0 where nothing is there to divide by."""
    xx = F.sum(F.col(x) * F.col(x))
    return df.groupBy(*by).agg(F.when(xx != 0, F.sum(F.col(x) * F.col(y)) / xx).otherwise(0.0).alias("factor"))


def p_norm(value: Column, p: float) -> Column:
    return F.pow(F.avg(F.pow(F.abs(value), F.lit(p))), F.lit(1 / p))


def summary(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """One line of text per group."""
    m = moments(df, value, by)
    return m.select(*by, F.format_string("Count=%d Mean=%.6f (Min=%.6f Max=%.6f) SD=%.6f", "n", "mean", "low", "high", F.sqrt("variance")).alias("summary"))
