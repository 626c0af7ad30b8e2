"""Tamper-evident records of route decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_seed(state: DataFrame, value: str, time: str) -> DataFrame:
    """One row: the state's fingerprint, its last time and mean to six places."""
    return state.agg(F.format_string("ts=%s;mean=%.6f", F.date_format(F.max(time), "yyyy-MM-dd HH:mm:ss"), F.coalesce(F.avg(value), F.lit(0.0))).alias("env_seed"))


def stake(decisions: DataFrame) -> DataFrame:
    """decisions (env_seed, route, timestamp) with stake_hash: the sha256 of their JSON, its keys in order."""
    return decisions.withColumn("stake_hash", F.sha2(F.to_json(F.struct("env_seed", "route", "timestamp")), 256))


def verify(hashes: DataFrame, audit: DataFrame) -> DataFrame:
    """hashes (stake_hash) with valid: whether the audit has them."""
    return hashes.join(audit.select("stake_hash").distinct().withColumn("_v", F.lit(True)), "stake_hash", "left").select("stake_hash", F.coalesce("_v", F.lit(False)).alias("valid"))
