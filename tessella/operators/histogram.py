"""Histograms, entropy, cluster costs, palettes and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed_bins(df: DataFrame, value: Column, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n): values truncate to a bin and clamp to the first and last."""
    at = F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def running(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts. A histogram is small; its window runs per group, and over all only if there is one."""
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0) if by else Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("upto", F.sum("n").over(w))


def symbols(df: DataFrame, context: str, symbol: str) -> DataFrame:
    return df.groupBy(context, symbol).agg(F.count(F.lit(1)).alias("n"))


def shannon_bits(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total bits of coding every symbol with its own share: N log2 N - sum n log2 n."""
    n = F.col("n")
    return counts.groupBy(*by).agg((F.sum(n) * F.log2(F.sum(n)) - F.sum(n * F.log2(n))).alias("bits"))


def cross_bits(counts: DataFrame, codes: DataFrame, symbol: str) -> DataFrame:
    """Bits of coding counts with the shares of codes; symbols that codes lack are left out on both sides."""
    q = codes.select(symbol, F.col("n").alias("q"))
    total = F.sum("q").over(Window.partitionBy(F.lit(0)))  # one row per symbol
    return counts.join(q.withColumn("total", total), symbol).agg((F.sum(F.col("n") * F.log2("total")) - F.sum(F.col("n") * F.log2("q"))).alias("bits"))


def flat_bits(n: Column, symbols_: Column) -> Column:
    return n * F.log2(symbols_)


def flat_histogram(total: Column, bins: int) -> Column:
    """total in equal parts, the remainder to the first bins."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.floor(total / bins) + F.when(i < total % bins, 1).otherwise(0))


def cluster_cost(a: Column, b: Column) -> Column:
    """Entropy that merging clusters of sizes a and b saves in the map of contexts."""
    term = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    return term(a) + term(b) - term(a + b)


def remap(counts: DataFrame, codes: DataFrame, context: str, cluster: str, symbol: str) -> DataFrame:
    """The cluster that codes each context cheapest, with add-one shares; ties to the smaller name.

    The clusters' table (cluster, symbol, n) is joined by symbol: what a context lacks costs nothing.
    """
    sizes = codes.groupBy(cluster).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"))
    q = codes.withColumnRenamed("n", "q")
    total = counts.groupBy(context).agg(F.sum("n").alias("all"))
    known = counts.join(q, symbol).groupBy(context, cluster).agg(F.sum(F.col("n") * F.log2(F.col("q") + 1)).alias("seen"))
    cost = known.join(sizes, cluster).join(total, context).withColumn("bits", F.round(F.col("all") * F.log2(F.col("size") + F.col("kinds")) - F.col("seen"), 6))
    best = F.min(F.struct("bits", cluster)).alias("m")
    return cost.groupBy(context).agg(best).select(context, F.col(f"m.{cluster}").alias("cluster"), F.col("m.bits").alias("bits"))


def reindex(df: DataFrame, label: str, position: str) -> DataFrame:
    """Labels renumbered from 0 in order of their first position. Ranks come from one row per label."""
    first = df.groupBy(label).agg(F.min(position).alias("first"))
    ranked = first.select(label, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first", label)) - 1).alias("code"))
    return df.join(ranked, label)


def palette(df: DataFrame, channel: str, value: str) -> DataFrame:
    """(channel, value, index): dense index of each channel's distinct values in order."""
    distinct = df.select(channel, value).distinct()
    return distinct.withColumn("index", F.row_number().over(Window.partitionBy(channel).orderBy(value)) - 1)


def apply_palette(df: DataFrame, colours: DataFrame, channel: str, value: str) -> DataFrame:
    return df.join(colours, [channel, value])


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(by..., run, value, start, n): maximal runs of equal values, as gaps and islands."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_i", F.row_number().over(w)).withColumn("_new", new)
    numbered = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias("value"), F.min("_i").alias("start"), F.count(F.lit(1)).alias("n"))


def all_equal(df: DataFrame, by: Sequence[str], value: str, least: int = 4) -> DataFrame:
    """Whether a group is a single run of at least `least` values."""
    return df.groupBy(*by).agg(((F.count(value) >= least) & (F.min(value) == F.max(value))).alias("single_run"))


def best_interval(df: DataFrame, by: Sequence[str], start: Column, end: Column, bins: int) -> DataFrame:
    """The bin that lies in most intervals [start, end], smallest first; as a difference array.

    The running sum starts at bin 1, and a best sum of 0 goes to bin 0.
    """
    ok = (start <= end) & (end >= 0) & (start <= bins - 1)
    low = F.greatest(F.ceil(start), F.lit(0)).cast("int")
    high = F.floor(F.least(end, F.lit(bins - 1)) + 1).cast("int")
    edges = df.where(ok).select(*by, F.explode(F.array(F.struct(low.alias("bin"), F.lit(1).alias("d")), F.struct(high.alias("bin"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(*by, F.col("e.bin").alias("bin")).agg(F.sum("e.d").alias("d")).where((F.col("bin") >= 1) & (F.col("bin") < bins))
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.withColumn("total", F.sum("d").over(w))
    top = sums.groupBy(*by).agg(F.max(F.struct(F.col("total"), (-F.col("bin")).alias("b"))).alias("m"))
    return df.select(*by).distinct().join(top, list(by), "left").select(*by, F.when(F.col("m.total") > 0, -F.col("m.b")).otherwise(0).alias("best"), F.greatest(F.coalesce("m.total", F.lit(0)), F.lit(0)).alias("best_sum"))
