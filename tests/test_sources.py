"""Folders, CSV, and the periodic stream job."""

from pyspark.sql import functions as F

from hazegrid.sources import files
from hazegrid.streaming import streams


def test_read_folder_skips_meta_and_names_time(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 01:10:00", 2.0)], "timestamp string, value double")
    d.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).coalesce(1).toPandas().to_parquet(tmp_path / "a.parquet", coerce_timestamps="us")
    spark.createDataFrame([(9.0,)], "value double").toPandas().to_parquet(tmp_path / "meta.parquet")
    got = files.read_folder(spark, str(tmp_path))
    assert got.columns[0] == "time" and sorted(r.value for r in got.collect()) == [1.0, 2.0]


def test_csv_and_partitioned_parquet(spark, tmp_path):
    d = spark.createDataFrame([("pm10", 1.0), ("no2", 2.0)], "parameter string, value double")
    files.write_csv(d, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    at = str(tmp_path / "p")
    files.write_parquet(d, at, ["parameter"])
    files.write_parquet(d.where("parameter = 'no2'").withColumn("value", F.lit(3.0)), at, ["parameter"])
    assert {(r.parameter, r.value) for r in spark.read.parquet(at).collect()} == {("pm10", 1.0), ("no2", 3.0)}


def test_refresh_gives_the_newest_payload_of_each_stream(spark, tmp_path):
    p = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", "x"), (2, "a", "2024-01-01 00:05:00", "y"), (3, "b", "2024-01-01 00:01:00", "z")], "event_id long, stream string, ts string, payload string").withColumn("ts", F.col("ts").cast("timestamp"))
    p.write.parquet(str(tmp_path / "in"))
    seen = []
    q = streams.refresh(streams.read_payloads(spark, str(tmp_path / "in")), lambda b, e: seen.extend((r.stream, r.payload) for r in b.collect()), str(tmp_path / "check"), "1 seconds")
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("a", "y"), ("b", "z")]
