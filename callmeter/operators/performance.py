"""Speed and reliability summaries with exact medians, from counted values: how often each value occurs is a partial aggregate that adds up over days,
so the medians of a period come from what is stored of its days (sinks.write_day_values), without its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written
from .usage import visible

METRICS = ("tps", "ttft_s", "duration_s")
#: The value under the metric "calls" of a call that failed; that of others is 0.
FAILED = 1.0


def counted_values(rows: DataFrame, by: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    """(by..., metric, value, n): how often each value of each column occurs, nulls left out; of the metric calls, how many failed or not."""
    calls = [F.struct(F.lit("calls").alias("metric"), F.when(F.col("status") == "failed", FAILED).otherwise(0.0).alias("value"))] if "status" in rows.columns else []
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns], *calls))
    return rows.select(*by, each.alias("m")).select(*by, "m.*").filter("value is not null").groupBy(*by, "metric", "value").agg(F.count("*").alias("n"))


def medians_of(counted: DataFrame, by: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    """(by..., median_<column>...): the mean of the middle two of each group's values, of counted(by..., metric, value, n) with each value once.

    The counts are summed in buckets of a 4096th of a doubling of the value, in which the middle
    ranks are found; only the values of those buckets are then ordered. No task holds a group's values."""
    doublings = F.floor((F.log2(F.abs("value")) + 1100) * 4096)
    counted = counted.filter(F.col("metric").isin(*columns)).withColumn("bucket", F.when(F.col("value") == 0, 0).otherwise(F.signum("value") * doublings).cast("long"))
    group = [*by, "metric"]
    upto = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = counted.groupBy(*group, "bucket").agg(F.sum("n").alias("size")).withColumn("end", F.sum("size").over(upto)).withColumn("total", F.sum("size").over(W.partitionBy(*group)))
    ranks = buckets.withColumn("low", F.expr("(total + 1) div 2")).withColumn("high", F.expr("(total + 2) div 2")).withColumn("before", F.col("end") - F.col("size"))
    middle = ranks.filter("(before < low and low <= end) or (before < high and high <= end)").select(*[F.col(c).alias(f"_{c}") for c in group], F.col("bucket").alias("_bucket"), "before", "low", "high")
    within = W.partitionBy(*group, "bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = counted.join(middle, _same(group) & (F.col("bucket") == F.col("_bucket"))).withColumn("end", F.sum("n").over(within) + F.col("before"))
    at = lambda rank: F.min(F.when(F.col(rank) <= F.col("end"), F.col("value")))
    pair = near.groupBy(*group).agg(at("low").alias("a"), at("high").alias("b"))
    return pair.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == c, F.col("a") + (F.col("b") - F.col("a")) * 0.5)).alias(f"median_{c}") for c in columns])


def medians(rows: DataFrame, by: list[str], columns: tuple[str, ...] = METRICS) -> DataFrame:
    """(by..., median_<column>...) of rows; how often each value occurs is written once."""
    return medians_of(written(counted_values(rows, by, columns), "values"), by, columns)


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return on


def _with(summary: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    return summary.join(found.withColumnsRenamed({c: f"_{c}" for c in by}), _same(by), "left").drop(*[f"_{c}" for c in by])


def by_provider(events: DataFrame, providers: tuple[str, ...] = ("ollama", "lmStudio")) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed", "cancelled")]
    accuracy = [F.count_if(F.col("token_accuracy") == a).alias(n) for a, n in (("estimated", "estimated"), ("unknown", "unknown_tokens"))]
    rows = visible(events).filter(F.col("provider").isin(*providers))
    return _with(rows.groupBy("provider").agg(F.count("*").alias("calls"), *counts, *accuracy), medians(rows, ["provider"]), ["provider"])


def day_values(events: DataFrame) -> DataFrame:
    """(day, provider, model, metric, value, n) of visible events: what is stored of a day."""
    return counted_values(visible(events).withColumn("day", F.to_date("ts")), ["day", "provider", "model"])


def of_values(values: DataFrame) -> DataFrame:
    """As by_model, from counted values(provider, model, metric, value, n) of any days."""
    by = ["provider", "model"]
    merged = written(values.groupBy(*by, "metric", "value").agg(F.sum("n").alias("n")), "values")
    calls = merged.filter("metric = 'calls'").groupBy(*by).agg(F.sum("n").alias("calls"), F.coalesce(F.sum(F.when(F.col("value") == FAILED, F.col("n"))), F.lit(0).cast("long")).alias("failed"))
    return _with(calls, medians_of(merged, by), by)


def by_model(events: DataFrame) -> DataFrame:
    return of_values(counted_values(visible(events), ["provider", "model"]))


def top_models(events: DataFrame, n: int = 5) -> DataFrame:
    return top_of(by_model(events), n)


def top_of(models: DataFrame, n: int = 5) -> DataFrame:
    return models.orderBy(F.desc("calls"), F.lower("model"), "provider").limit(n)
