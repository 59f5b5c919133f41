"""Duplicates across collectors as they arrive, micro-batch by micro-batch.

Stored rows and a batch meet in band joins of 90 seconds, which bounds how far back a match can lie. A proxy call that arrives is shadowed if
any exact transcript row that is there or arrives with it explains it. A transcript row that arrives shadows the latest stored proxy
call that it explains, one at most; a replay over everything (reconcile) later finds the rest. Desktop rows and proxy calls
likewise, where the desktop side is shadowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reconcile import band, overlap, seen_tokens

SECONDS, DESKTOP_SECONDS, TOKENS = 90, 4, 2


def _latest(pairs: DataFrame) -> DataFrame:
    """Of pairs(dedup_key, ts, by) the latest row of each `by`."""
    return pairs.groupBy("by").agg(F.max_by("dedup_key", F.struct("ts", "dedup_key")).alias("dedup_key")).select("dedup_key")


def _proxies(rows: DataFrame) -> DataFrame:
    return rows.filter("source = 'proxy' and provider = 'ollama' and not coalesce(shadowed, false)")


def _exact(rows: DataFrame) -> DataFrame:
    return rows.filter("source = 'transcript' and provider = 'ollama' and token_accuracy = 'exact'")


def _desktop(rows: DataFrame) -> DataFrame:
    return rows.filter("source = 'ollamaDesktop' and provider = 'ollama' and not coalesce(shadowed, false)")


def shadowed_by_arrival(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(dedup_key) of proxy calls of stored and batch that the batch's arrival shadows."""
    either = stored.unionByName(batch)
    arrived = band(_proxies(batch), seen_tokens(_exact(either), TOKENS), SECONDS, ["output_tokens"], F.lit(True), "left_semi").select("dedup_key")
    met = band(_proxies(stored), seen_tokens(_exact(batch), TOKENS), SECONDS, ["output_tokens"], F.lit(True), "inner")
    return arrived.unionByName(_latest(met.select("dedup_key", "ts", F.col("r_key").alias("by")))).distinct()


def desktop_by_arrival(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(dedup_key) of desktop rows of stored and batch that unshadowed proxy calls shadow as the batch arrives."""
    seen = lambda rows: _proxies(rows).select(F.col("dedup_key").alias("r_key"), F.col("ts").alias("r_ts"), F.col("model").alias("r_model"), F.col("started_at").alias("r_started"))
    near: Column = overlap(DESKTOP_SECONDS)
    arrived = band(_desktop(batch), seen(stored.unionByName(batch)), DESKTOP_SECONDS, [], near, "left_semi").select("dedup_key")
    met = band(_desktop(stored), seen(batch), DESKTOP_SECONDS, [], near, "inner")
    return arrived.unionByName(_latest(met.select("dedup_key", "ts", F.col("r_key").alias("by")))).distinct()
