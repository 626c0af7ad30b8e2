"""Parquet and CSV sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.operators.quality import pick_column


def read_station_files(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Year files with the needed columns, one after another; files that lack one are left out. Schemas come from footers only."""
    frames = [spark.read.parquet(p) for p in paths]
    good = [f.select(*columns) for f in frames if set(columns) <= set(f.columns)]
    if not good:
        raise ValueError("no file has the needed columns")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)


def read_folder(spark: SparkSession, folder: str, time_names: Sequence[str] = ("time", "timestamp", "datetime", "date")) -> DataFrame:
    """All Parquet files of a folder but meta.parquet, with the first of the time columns as a wall-clock `time`."""
    d = spark.read.option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(folder).where(F.col("_metadata.file_name") != "meta.parquet")
    name = pick_column(d, time_names)
    return d.withColumn(name, F.col(name).cast("timestamp_ntz")).withColumnRenamed(name, "time")


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Snappy Parquet, replaced by Spark's commit; only the partitions that df holds where `by` is given. Never a path that df reads."""
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def file_system(spark: SparkSession, at: str):
    """Hadoop's file system of a path, and its constructor of paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def listed(spark: SparkSession, at: str) -> list[str]:
    """Paths of the files in a folder."""
    fs, path = file_system(spark, at)
    return [x.getPath().toString() for x in fs.listStatus(path(at))]
