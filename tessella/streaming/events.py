"""The mergeable aggregates over a stream of events; an extension, since nothing in the batch library streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_power_sums(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Power sums of each event type and window; they merge by addition, so late rows only add to theirs."""
    v = F.col("value").cast("double")
    sums = [F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), *[F.sum(F.pow(v, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)]]
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(*sums)
