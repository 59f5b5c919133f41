"""Duplicate observations of one call: the strongest for each key, and calls that two collectors saw.

The band joins are equi joins: one side is exploded over the few token counts and time buckets within tolerance, and the
exact bounds are a residual predicate. No row is compared with all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import ACCURACY_RANK, TERMINAL_RANK
from ..scratch import written


def _rank(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def strength() -> Column:
    """Accuracy, terminal status, token evidence, metrics present; on ties the earlier arrival."""
    evidence = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read") + F.col("cache_create")
    metrics = sum((F.col(c).isNotNull().cast("int") for c in ("ttft_s", "tps", "load_s")), F.col("duration_s").isNotNull().cast("int"))
    return F.struct(_rank("token_accuracy", ACCURACY_RANK), _rank("status", TERMINAL_RANK), evidence, metrics, -F.col("arrival_seq"))


def strongest_keyed(observations: DataFrame) -> DataFrame:
    """One row for each dedup_key, dealt by it; rows without one are left out."""
    # rank 1 of a window: weaker rows go before the exchange, and whole rows cross it once
    first = F.row_number().over(W.partitionBy("dedup_key").orderBy(strength().desc()))
    return observations.filter("dedup_key is not null").withColumn("_rank", first).filter("_rank = 1").select(*observations.columns)


def strongest_per_key(observations: DataFrame) -> DataFrame:
    """One row for each dedup_key. Rows without a key are calls of their own."""
    return strongest_keyed(observations).unionByName(observations.filter("dedup_key is null"))


def _micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def band(left: DataFrame, right: DataFrame, seconds: int, keys: list[str], condition: Column, how: str) -> DataFrame:
    """left rows joined (how: left_semi or inner) with right rows of equal keys, less than `seconds` away, that meet the condition
    (right columns: r_*)."""
    size = seconds * 1_000_000
    a = left.withColumn("us", _micros("ts")).withColumn("bucket", F.floor(F.col("us") / size))
    b = right.withColumn("r_us", _micros("r_ts")).withColumn("r_bucket", F.explode(F.sequence(F.floor(F.col("r_us") / size) - 1, F.floor(F.col("r_us") / size) + 1)))
    on = (F.col("bucket") == F.col("r_bucket")) & (F.abs(F.col("us") - F.col("r_us")) < size) & condition
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return a.join(b, on, how).drop("us", "bucket", "r_us", "r_bucket")


def seen_tokens(rows: DataFrame, tokens: int) -> DataFrame:
    """(r_key, r_ts, r_output_tokens) of rows for each output count within `tokens`."""
    return rows.select(F.col("dedup_key").alias("r_key"), F.col("ts").alias("r_ts"), F.explode(F.sequence(F.col("output_tokens") - tokens, F.col("output_tokens") + tokens)).alias("r_output_tokens"))


def overlap(seconds: int) -> Column:
    """A desktop row and a proxy call (r_*): equal model or none on the desktop side, and the desktop row not started over `seconds` before."""
    started = F.coalesce(_micros("started_at") - _micros("r_started") >= -seconds * 1_000_000, F.lit(True))
    return ((F.col("model") == F.col("r_model")) | (F.coalesce("model", F.lit("")) == "")) & started


def shadowed_proxies(events: DataFrame, tokens: int = 2, seconds: int = 120) -> DataFrame:
    """Proxy calls that some exact Ollama transcript row explains: output within `tokens`, time within `seconds` (exclusive)."""
    proxies = events.filter((F.col("source") == "proxy") & (F.col("provider") == "ollama"))
    seen = events.filter((F.col("source") == "transcript") & (F.col("provider") == "ollama") & (F.col("token_accuracy") == "exact"))
    return band(proxies, seen_tokens(seen, tokens), seconds, ["output_tokens"], F.lit(True), "left_semi")


def shadowed_desktop(events: DataFrame, seconds: int = 4) -> DataFrame:
    """Desktop rows that an unshadowed proxy call explains: ends within `seconds`, and overlap()."""
    desktop = events.filter("source = 'ollamaDesktop' and provider = 'ollama'")
    proxies = events.filter("source = 'proxy' and provider = 'ollama' and not coalesce(shadowed, false)").select(F.col("ts").alias("r_ts"), F.col("model").alias("r_model"), F.col("started_at").alias("r_started"))
    return band(desktop, proxies, seconds, [], overlap(seconds), "left_semi")


def mark(events: DataFrame, hidden: DataFrame) -> DataFrame:
    """events with shadowed set on the rows whose dedup_key is in hidden."""
    keys = hidden.select("dedup_key", F.lit(True).alias("hit")).distinct()
    return events.join(keys, "dedup_key", "left").withColumn("shadowed", F.coalesce("shadowed", F.lit(False)) | F.coalesce("hit", F.lit(False))).drop("hit").select(*events.columns)


#: What the band joins look at.
BAND = ("dedup_key", "ts", "started_at", "source", "provider", "model", "output_tokens", "token_accuracy", "shadowed")


def reconcile(observations: DataFrame) -> DataFrame:
    """Silver events: strongest for each key, proxies shadowed by transcripts, then desktop rows by the remaining proxies. The strongest
    rows and the keys of shadowed ones are written once, and the band joins read a few columns of Ollama's rows."""
    events = written(strongest_per_key(observations).withColumn("shadowed", F.lit(False)), "strongest")
    ollama = events.filter("provider = 'ollama' and dedup_key is not null").select(*BAND)
    proxies = written(shadowed_proxies(ollama).select("dedup_key").distinct(), "shadowed")
    desktop = shadowed_desktop(ollama.join(proxies, "dedup_key", "left_anti"))
    return mark(events, written(proxies.unionByName(desktop.select("dedup_key")).distinct(), "hidden"))
