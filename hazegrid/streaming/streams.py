"""Structured Streaming jobs over payload streams (stream, ts, payload)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "event_id LONG, stream STRING, ts TIMESTAMP, payload STRING"


def read_payloads(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Payload files as a stream; for Kafka, read the topic and select the same columns."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def publish(df: DataFrame, stream: str, columns: list[str], time: str) -> DataFrame:
    """Rows as JSON payloads of a stream."""
    return df.select(F.lit(stream).alias("stream"), F.col(time).cast("timestamp").alias("ts"), F.to_json(F.struct(*columns)).alias("payload"))


def latest(payloads: DataFrame, order: str = "ts") -> DataFrame:
    """The newest payload of each stream; batch or stream (complete or update mode)."""
    return payloads.groupBy("stream").agg(F.max_by("payload", F.struct(order, "event_id")).alias("payload"), F.max(order).alias("ts"))


def as_of(snapshots: DataFrame, payloads: DataFrame, streams: list[str]) -> DataFrame:
    """snapshots (snapshot_id, ts) with the last payload of each stream at or before them: one pass over the union in time order, by day with carried ends."""
    both = payloads.select("ts", F.lit(1).alias("_k"), F.lit(None).cast("long").alias("snapshot_id"), *[F.when(F.col("stream") == s, F.col("payload")).alias(f"p{i}") for i, s in enumerate(streams)], F.col("event_id").alias("_e"))
    both = both.unionByName(snapshots.select("ts", F.lit(2).alias("_k"), "snapshot_id", *[F.lit(None).cast("string").alias(f"p{i}") for i in range(len(streams))], F.lit(None).cast("long").alias("_e"))).withColumn("_day", F.to_date("ts"))
    order = ["ts", "_k", "_e"]
    w = Window.partitionBy("_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ps = [f"p{i}" for i in range(len(streams))]
    inside = both.withColumns({p: F.last(p, True).over(w) for p in ps})
    # what each day ends with, carried over the days: a row a day
    ends = both.groupBy("_day").agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.struct(*order))).alias(f"_end_{p}") for p in ps])
    prior = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_day", *[F.last(f"_end_{p}", True).over(prior).alias(f"_in_{p}") for p in ps])
    out = inside.where("_k = 2").join(ends, "_day", "left")
    return out.select("snapshot_id", "ts", *[F.coalesce(p, f"_in_{p}").alias(s.replace(":", "_")) for p, s in zip(ps, streams)])


def retain(payloads: DataFrame, n: int = 30) -> DataFrame:
    """The n newest payloads of each stream."""
    return payloads.withColumn("_rn", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("_rn") <= n).drop("_rn")


def retain_into(path: str, n: int = 30) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the n newest payloads of each stream in a table of versions, read from the last and written as the next."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(SCHEMA).parquet(f"{path}/v{epoch - 1}") if epoch else None
        retain(batch if old is None else old.unionByName(batch), n).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return run


def hourly_means(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Station means by hour with a watermark; `ts` must be a timestamp with zone."""
    w = readings.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "station_id", "parameter").agg(F.avg("value").alias("value"))
    return w.select(F.col("window.start").alias("hour"), "station_id", "parameter", "value")


def drop_duplicates(readings: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark (an upsert keeps the last instead)."""
    return readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def refresh(payloads: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, every: str = "300 seconds"):
    """Runs a batch job over the newest payloads at each trigger."""
    return payloads.writeStream.foreachBatch(lambda b, e: job(latest(b), e)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """All that is there now, into Parquet; waits for the end."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
