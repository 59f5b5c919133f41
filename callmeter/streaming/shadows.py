"""Calls that two collectors saw, found as the calls stream in.

One stream-stream join over one stream of events, on kind, time buckets and (for transcripts) output counts: proxy calls that an exact transcript row
explains, and desktop rows that a proxy call explains. One join for both kinds is half the state stores that each micro-batch commits. The time band
bounds the join's state: a row goes once the watermark is past all that it could meet. A micro-batch without rows finds no pair, so
spark.sql.streaming.noDataMicroBatches.enabled may be false: state goes with the next rows then. Each row carries the time of its micro-batch, so a pair tells which of its two arrived first, and the rule of operators.arrival is applied to the
pairs of a micro-batch: what arrives is shadowed by any row that is there or comes with it; what is there already is shadowed by a row that
arrives only if it is the latest that this row explains. Then the store hides the keys; those it has not seen yet it hides when they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.arrival import DESKTOP_SECONDS, SECONDS, TOKENS
from ..operators.reconcile import overlap
from ..scratch import written
from .store import Store


def _bucket(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / (seconds * 1_000_000))


def _near(seconds: int) -> Column:
    apart = F.expr(f"interval {seconds} seconds")
    return (F.col("r_at") > F.col("at") - apart) & (F.col("r_at") < F.col("at") + apart)


def _buckets(seconds: int) -> Column:
    own = _bucket("at", seconds)
    return F.explode(F.sequence(own - 1, own + 1)).alias("r_bucket")


def pairs(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(kind, key, at, by, arrived, by_arrived) of a stream of usage events: `by` explains `key`, which is a proxy call or a desktop row. Rows that come
    more than `late` after later ones are left out."""
    e = events.filter("provider = 'ollama' and dedup_key is not null").withColumns({"at": F.col("ts").cast("timestamp"), "arrived": F.current_timestamp()}).withWatermark("at", late)
    proxies, seen, desktop = e.filter("source = 'proxy'"), e.filter("source = 'transcript' and token_accuracy = 'exact'"), e.filter("source = 'ollamaDesktop'")
    left = lambda kind, rows, seconds, tokens: rows.select(F.lit(kind).alias("kind"), F.col("dedup_key").alias("key"), "at", "arrived", _bucket("at", seconds).alias("bucket"), tokens.cast("long").alias("tokens"), "model", "started_at")
    right = lambda kind, rows, seconds, tokens: rows.select(F.lit(kind).alias("r_kind"), F.col("dedup_key").alias("by"), F.col("at").alias("r_at"), F.col("arrived").alias("by_arrived"), tokens.cast("long").alias("r_tokens"), F.col("model").alias("r_model"), F.col("started_at").alias("r_started"), _buckets(seconds))
    counted = seen.withColumn("about", F.explode(F.sequence(F.col("output_tokens") - TOKENS, F.col("output_tokens") + TOKENS)))
    told = left("proxy", proxies, SECONDS, F.col("output_tokens")).unionByName(left("desktop", desktop, DESKTOP_SECONDS, F.lit(0)))
    by = right("proxy", counted, SECONDS, F.col("about")).unionByName(right("desktop", proxies, DESKTOP_SECONDS, F.lit(0)))
    same = (F.col("kind") == F.col("r_kind")) & (F.col("bucket") == F.col("r_bucket")) & (F.col("tokens") == F.col("r_tokens"))
    met = told.join(by, same & _near(max(SECONDS, DESKTOP_SECONDS)) & (((F.col("kind") == "proxy") & _near(SECONDS)) | ((F.col("kind") == "desktop") & _near(DESKTOP_SECONDS) & overlap(DESKTOP_SECONDS))))
    return met.select("kind", "key", "at", "by", "arrived", "by_arrived")


def _decided(found: DataFrame) -> DataFrame:
    """(dedup_key) that pairs of one micro-batch shadow."""
    at_once = found.filter("arrived >= by_arrived").select(F.col("key").alias("dedup_key"))
    later = found.filter("arrived < by_arrived").groupBy("by").agg(F.max_by("key", F.struct("at", "key")).alias("dedup_key")).select("dedup_key")
    return at_once.unionByName(later).distinct()


def hide(store: Store, stream: str = "shadows") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over pairs(). Proxy calls come first: one that is shadowed explains no desktop row."""

    def run(found: DataFrame, number: int) -> None:
        found = written(found, "pairs", store.spark)
        keys = lambda rows, c: rows.select(F.col(c).alias("dedup_key"))
        for kind in ("proxy", "desktop"):
            if store.versions.latest()["streams"].get(f"{stream}/{kind}", -1) >= number:
                continue
            own = found.filter(F.col("kind") == kind)
            if own.isEmpty():
                continue
            own = own.join(keys(store.hidden_among(keys(own, "key")), "dedup_key"), F.col("key") == F.col("dedup_key"), "left_anti")
            if kind == "desktop":
                own = own.join(store.hidden_among(keys(own, "by")), F.col("by") == F.col("dedup_key"), "left_anti")
            store.hide(_decided(own), f"{stream}/{kind}", number)

    return run
