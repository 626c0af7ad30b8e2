"""Merging fetched rows: counts are growth of the store, untouched partitions keep their files, every status has its message."""

import datetime as dt
import os

from hazegrid.operators import backfill

KEYS = ["time", "station_id", "parameter"]
T = dt.datetime(2024, 3, 1)


def at(day, year=2024):
    return dt.datetime(year, 3, day)


def test_counts_statuses_and_messages(spark):
    stored = spark.createDataFrame([(at(1), 1, "co"), (at(2), 1, "co"), (None, 1, "co")], "time timestamp_ntz, station_id int, parameter string")
    rows = [(1, "a", at(3)), (2, "a", at(3)), (3, "a", at(3)), (4, "a", at(1)), (5, "b", at(3)), (6, "b", at(2)), (7, "c", at(4, 2023)), (8, "c", at(5, 2022)), (9, "d", None), (10, "g", at(4))]
    fetched = spark.createDataFrame([(s, k, t, 1, "co") for s, k, t in rows], "seq long, task_id string, time timestamp_ntz, station_id int, parameter string")
    tasks = spark.createDataFrame([("a", 2024, 200), ("b", 2024, 200), ("c", 2024, 200), ("d", 2024, 200), ("e", 2024, 200), ("f", 2024, 429), ("g", 2024, 500), ("h", 2024, None)], "task_id string, year int, http_status int")
    got = {r.task_id: (r.raw_api_rows, r.api_rows, r.year_filtered_out_rows, r.dedupe_overlap_rows, r.inserted_rows, r.status, r.message) for r in backfill.upsert_events(stored, fetched, tasks, KEYS, "time", "seq").collect()}
    assert got == {
        "a": (4, 4, 0, 3, 1, "success", "inserted_new_rows"),  # three rows of one new key grow the store by one
        "b": (2, 2, 0, 2, 0, "confirmed_missing", "not_inserted_all_rows_already_present_after_dedupe"),
        "c": (2, 0, 2, 0, 0, "confirmed_missing", "not_inserted_rows_outside_target_year"),
        "d": (1, 0, 1, 0, 0, "confirmed_missing", "not_inserted_rows_outside_target_year"),
        "e": (0, 0, 0, 0, 0, "confirmed_missing", "api_returned_no_rows_for_requested_window"),
        "f": (0, 0, 0, 0, 0, "failed", "http_status_429"),
        "g": (1, 1, 0, 0, 1, "success", "inserted_new_rows"),
        "h": (0, 0, 0, 0, 0, "failed", "http_status_none"),
    }


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("year=")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "store")
    kind = "time timestamp_ntz, station_id int, parameter string, value double, seq long, year int"
    spark.createDataFrame([(at(d, y), s, "co", 1.0, 1, y) for y in (2022, 2023, 2024) for d in (1, 2) for s in (1, 2)], kind).write.partitionBy("year").parquet(path)
    before = files(path)
    new = [(at(1, 2023), 1, "co", 2.0, 5, 2023), (at(1, 2023), 1, "co", 3.0, 6, 2023), (at(9, 2023), 1, "co", 4.0, 7, 2023), (at(9, 2025), 1, "co", 5.0, 8, 2025)]
    read = backfill.merge(path, spark.createDataFrame(new, kind), KEYS, "seq", "year")
    assert {f.split("year=")[1][:4] for f in read.inputFiles()} == {"2022", "2023", "2024"} and "PartitionFilters: [year" in read._jdf.queryExecution().executedPlan().toString()
    after = files(path)
    assert after["year=2022"] == before["year=2022"] and after["year=2024"] == before["year=2024"] and after["year=2023"] != before["year=2023"]
    rows = spark.read.parquet(path)
    assert rows.count() == 12 + 2
    assert {r.value for r in rows.where("year = 2023 and station_id = 1").collect()} == {3.0, 1.0, 4.0} and rows.where("year = 2025").count() == 1
    backfill.merge(path, spark.createDataFrame(new, kind), KEYS, "seq", "year")  # once more changes nothing
    assert spark.read.parquet(path).count() == 14
