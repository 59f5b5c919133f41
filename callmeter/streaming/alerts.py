"""Alerts and changes as readings stream in, with what was told before kept over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import limits
from .ordered import previous


def threshold_alerts(history: DataFrame, late: str = "0 seconds") -> DataFrame:
    """As limits.threshold_alerts, for a stream."""
    told = previous(history.withColumn("band", limits.top_band()), ["account", "window"], F.col("band"), "last", late)
    return limits.crossed(told.withColumn("last", F.col("last").cast("int")))


def status_changes(history: DataFrame, late: str = "0 seconds") -> DataFrame:
    """As status.changes, for a stream."""
    found = previous(history.filter("indicator is not null"), ["service"], F.col("indicator"), "before", late)
    return found.filter("before is not null and before <> indicator")


def significant(snapshots: DataFrame, key: str, fields: list[str], late: str = "0 seconds") -> DataFrame:
    """As status.significant, for a stream."""
    found = previous(snapshots.withColumn("_now", F.xxhash64(*fields)), [key], F.col("_now"), "_last", late)
    return found.filter(F.col("_last").isNull() | (F.col("_last") != F.col("_now").cast("string"))).drop("_last", "_now")
