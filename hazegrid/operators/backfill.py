"""Backfill tasks, retries and upserts of yearly station files, as joins over all tasks at once."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.operators.scratch import drop_table, shared_checkpoint, shared_dir
from hazegrid.operators.series import date_ranges, keep_last


def tasks(expected: DataFrame, present: DataFrame, meta: DataFrame, year: int) -> DataFrame:
    """Tasks of a year: whole-year ones for stations with no row, and one per missing day range for each other station, by sensor.

    expected (station_id), present (station_id, day), meta (id, name, sensors). A day is missing if no station has it.
    """
    first, last = f"{year}-01-01", f"{year}-12-31"
    there = present.where(F.year("day") == year)
    stations = there.select("station_id").distinct()
    absent = expected.select("station_id").distinct().join(stations, "station_id", "left_anti").withColumns({"task_type": F.lit("missing_station"), "date_from": F.lit(first).cast("date"), "date_to": F.lit(last).cast("date")})
    calendar = present.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    gaps = date_ranges(calendar.join(there.select("day").distinct(), "day", "left_anti").withColumn("y", F.lit(year)), ["y"], "day").select("date_from", "date_to")
    ranged = stations.crossJoin(F.broadcast(gaps)).select("station_id", F.lit("missing_range").alias("task_type"), "date_from", "date_to")  # at most 183 ranges a year
    sensors = meta.select(F.col("id").alias("station_id"), F.col("name").alias("station_name"), F.explode("sensors").alias("parameter", "sensor_id"))
    out = absent.select("station_id", "task_type", "date_from", "date_to").unionByName(ranged).join(sensors, "station_id")
    task_id = F.concat_ws("|", F.lit(str(year)), "station_id", "parameter", F.col("date_from").cast("string"), F.col("date_to").cast("string"))
    return out.withColumn("year", F.lit(year)).withColumn("task_id", task_id).dropDuplicates(["task_id"])


def year_order(year, last: int = 2023):
    """Sort key of a year: ascending, with one year last."""
    return F.when(year == last, 9999).otherwise(year)


def ordered(tasks_df: DataFrame, first_n: int | None = None) -> DataFrame:
    out = tasks_df.orderBy(year_order(F.col("year")), "station_id", "parameter", "date_from")
    return out.limit(first_n) if first_n else out


def retries(events: DataFrame, candidates: DataFrame, year: int) -> DataFrame:
    """Tasks of a year that were confirmed missing, each with its sensor and the candidates of its station, in order and once each."""
    e = events.where((F.col("year") == year) & (F.col("status") == "confirmed_missing")).dropDuplicates(["task_id"])
    j = e.join(candidates, ["station_id", "parameter"], "left")
    return j.withColumn("sensor_ids", F.array_distinct(F.concat(F.array("sensor_id"), F.coalesce("candidates", F.array().cast("array<bigint>"))))).drop("candidates")


def upsert(stored: DataFrame, fetched: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """stored and fetched with the newest row of each key; fetched rows carry higher sequence numbers."""
    return keep_last(stored.unionByName(fetched, allowMissingColumns=True), keys, sequence)


def merge(at: str, fetched: DataFrame, keys: list[str], sequence: str, part: str) -> DataFrame:
    """Merges fetched rows into the table at a folder, which is kept by `part`: the newest row of each key stays. Returns what it read.

    Only partitions that fetched rows fall into are read and rewritten; files of the others stay as they are. The new partitions
    are staged first, so a run that dies leaves the old ones or is repeated with the same result. keys include `part` or decide it.
    """
    spark = fetched.sparkSession
    fetched = shared_checkpoint(fetched)
    touched = [r[0] for r in fetched.select(part).distinct().collect()]  # names of partitions, which the driver lists anyway
    stored = spark.read.parquet(at).where(F.col(part).isin(touched))
    staged = f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}"
    upsert(stored, fetched.select(*stored.columns), keys, sequence).repartition(part).write.partitionBy(part).parquet(staged)
    spark.read.schema(stored.schema).parquet(staged).select(*stored.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(at)
    drop_table(spark, staged)
    return stored


def upsert_events(stored: DataFrame, fetched: DataFrame, tasks_df: DataFrame, keys: list[str], time: str, sequence: str) -> DataFrame:
    """What each task's fetch did to the store, tasks taken in order of `sequence`: raw, kept and filtered-out rows, overlap, inserted rows, status and message.

    tasks_df (task_id, year, http_status); fetched has task_id and a rising sequence over all tasks. A key counts as inserted
    once, for the first task that brings it, and only if it is not stored: the sum of inserted rows is the growth of the store.
    All other rows of the task's year overlap. A task without rows has failed if its status is not 200.
    """
    f = fetched.join(tasks_df.select("task_id", "year"), "task_id").withColumn("_inside", F.coalesce(F.year(time) == F.col("year"), F.lit(False)))
    raw = f.groupBy("task_id").agg(F.count("*").alias("raw_api_rows"), F.count_if("_inside").alias("api_rows"))
    first = f.where("_inside").groupBy(*keys).agg(F.min_by("task_id", sequence).alias("task_id"))
    # null keys are equal, as they are when rows are merged
    known = stored.select(*[F.col(k).alias(f"_s_{k}") for k in keys]).distinct()
    new = first.join(known, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys)), "left_anti").groupBy("task_id").agg(F.count("*").alias("inserted_rows"))
    n = tasks_df.select("task_id", "year", "http_status").join(raw, "task_id", "left").join(new, "task_id", "left").na.fill(0, ["raw_api_rows", "api_rows", "inserted_rows"])
    rows, inserted, fine = F.col("api_rows") > 0, F.col("inserted_rows") > 0, F.coalesce(F.col("http_status") == 200, F.lit(False))
    status = F.when(inserted, "success").when(rows | fine, "confirmed_missing").otherwise("failed")
    message = F.when(inserted, "inserted_new_rows").when(rows, "not_inserted_all_rows_already_present_after_dedupe").when(fine & (F.col("raw_api_rows") > 0), "not_inserted_rows_outside_target_year").when(fine, "api_returned_no_rows_for_requested_window").otherwise(F.concat(F.lit("http_status_"), F.coalesce(F.col("http_status").cast("string"), F.lit("none"))))
    return n.select("task_id", "http_status", "raw_api_rows", "api_rows", (F.col("raw_api_rows") - F.col("api_rows")).alias("year_filtered_out_rows"), (F.col("api_rows") - F.col("inserted_rows")).alias("dedupe_overlap_rows"), "inserted_rows", status.alias("status"), message.alias("message"))


def event_summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("tasks"), *[F.count_if(F.col("status") == s).alias(s) for s in ("inserted", "already_present", "confirmed_missing", "failed")], F.sum("inserted_rows").alias("inserted_rows"))
