"""Streaming forms: strongest-wins upserts, live calls with a time limit, tumbling totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .store import Store

STALE_SECONDS = 180


def upsert_days(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: one stored row for each dedup_key, its strongest, in the day of its ts (streaming.store)."""
    return Store(spark, folder).upsert()


def latest_days(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows."""
    return Store(spark, folder).rows()


def newest_epochs(spark: SparkSession, folder: str) -> dict[str, int]:
    """For each day the version that wrote it last: one entry for each day."""
    held = Store(spark, folder).versions.latest()["tables"].get("rows", {})
    return {day: max(int(f.split("/")[1][:12]) for f in folders) for day, folders in held.items() if folders}


def compact(spark: SparkSession, folder: str, epoch: int | None = None) -> None:
    """Writes every partition anew, between any batches; what is replaced goes with the version after the next. A version has its own number, so
    epoch says nothing."""
    store = Store(spark, folder)
    store.compact(folders=1)
    store.versions.remove_unused()


def live_calls(updates: DataFrame) -> DataFrame:
    """Running calls of updates(call_id, ts, output_tokens, status): counters only rise, an ended call leaves, and one without an
    update for STALE_SECONDS leaves as stale. Needs a watermark on ts."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            output, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="us"), output, "stale")], columns=["call_id", "ts", "output_tokens", "status"])
            return
        output, last = state.get if state.exists else (0, 0)
        status = "running"
        for b in batches:
            output, last = max(output, int(b["output_tokens"].max())), max(last, int(b["ts"].astype("datetime64[us]").astype("int64").max()))
            done = b.loc[b["status"] != "running", "status"]
            status = done.iloc[-1] if len(done) else status
        if status == "running":
            state.update((output, last))
            state.setTimeoutTimestamp(max(last // 1000 + STALE_SECONDS * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], pd.Timestamp(last, unit="us"), output, status)], columns=["call_id", "ts", "output_tokens", "status"])

    return updates.groupBy("call_id").applyInPandasWithState(run, "call_id string, ts timestamp, output_tokens long, status string", "output long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Totals of each provider and window, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "provider").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("calls"))


def throttled(updates: DataFrame, seconds: float = 0.2) -> DataFrame:
    """Updates of calls (call_id, ts, ...): the last one of each slot of `seconds` since the call's first, and the first itself."""
    begins = updates.groupBy("call_id").agg(F.min("ts").alias("begin"))
    since = F.expr("timestampdiff(MICROSECOND, begin, ts)")
    slots = updates.join(begins, "call_id").withColumn("slot", F.when(since == 0, -1).otherwise(F.floor(since / (seconds * 1e6)).cast("long")))
    last = F.max_by(F.struct(*updates.columns), F.struct("ts", *[c for c in updates.columns if c not in ("call_id", "ts")]))
    return slots.groupBy("call_id", "slot").agg(last.alias("u")).select("u.*")


def live_display(calls: DataFrame) -> DataFrame:
    """Running calls of calls(call_id, model, operation, input, cache_read, output, approx_output, saw_usage, started_at) as they are shown:
    input with what came from the cache, and the counted output where none is told."""
    output = F.when(F.col("output") > 0, F.col("output")).otherwise(F.col("approx_output"))
    accuracy = F.when(F.col("saw_usage"), "exact").when(output > 0, "estimated").otherwise("unknown")
    return calls.select("call_id", "model", "operation", (F.col("input") + F.col("cache_read")).alias("input_tokens"), output.alias("output_tokens"), accuracy.alias("output_accuracy"), "started_at")
