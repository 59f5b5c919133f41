"""What stood before, for long histories: a key's rows are cut into blocks (of time, or of a file's bytes), each block is
ordered on its own, and only one value of each block is carried from block to block. So a key with most of the rows is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_time(rows: DataFrame) -> list[str]:
    """ts, and on equal times the arrival where rows tell it."""
    return ["ts", *(c for c in ("arrival_seq",) if c in rows.columns)]


def _with_earlier(rows: DataFrame, keys: list[str], order: Column, value: Column) -> DataFrame:
    """rows(_block, ...) with _earlier: the last value that is not null of the key's blocks before, as a struct of it; null if none."""
    last = rows.groupBy(*keys, "_block").agg(F.max_by(F.struct(value.alias("v")), F.when(value.isNotNull(), order)).alias("last"))
    before = F.last("last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    earlier = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_at"), before.alias("_earlier"))
    on = F.col("_block") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(earlier, on, "left").drop("_at", *[f"_k_{k}" for k in keys])


def previous(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the value of the row before of the same keys; null for the first. Values must not be null."""
    rows = rows.withColumn("_block", block).withColumn("_value", value)
    w = W.partitionBy(*keys, "_block").orderBy(*order)
    found = _with_earlier(rows, keys, F.struct(*order), F.col("_value"))
    return found.withColumn(name, F.coalesce(F.lag("_value").over(w), F.col("_earlier.v"))).drop("_block", "_value", "_earlier")


def carried(rows: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last value that is not null at or before each, of the same keys."""
    rows = rows.withColumn("_block", block).withColumn("_value", value)
    w = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = _with_earlier(rows, keys, F.struct(*order), F.col("_value"))
    return found.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(w), F.col("_earlier.v"))).drop("_block", "_value", "_earlier")
