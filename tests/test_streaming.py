"""The streaming aggregate over files that arrive one after another equals the same over all of them at once."""

from pyspark.sql import functions as F

from tessella.streaming import events


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", "view" if i % 3 else "error", float(i % 17)) for i in range(300)]
    table = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    folder, out = f"{tmp_path}/in", []
    for part in range(3):
        table.where(f"event_id % 3 = {part}").write.mode("append").parquet(folder)
    sums = events.windowed_power_sums(events.read(spark, folder, table.schema).repartition(2), late="10 hours")
    query = sums.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, _: out.append(df.collect())).start()
    query.awaitTermination(120)
    assert sorted(map(str, out[-1])) == sorted(map(str, events.windowed_power_sums(table).collect()))
