"""The live window and what leaves it: cutoffs in whole days, retention, folding into history, backfill and its watermarks.

A day is either live or frozen: live rows are those from the cutoff on, history holds the days before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .usage import day_fold, merge_history

#: Days of the live window and of the furthest backfill.
LIVE_DAYS, BACKFILL_DAYS = 31, 366
WATERMARK = "collector string, complete_through timestamp_ntz"


def cutoff(as_of: str) -> Column:
    """Start of the day LIVE_DAYS before as_of's."""
    return F.date_sub(F.to_date(F.lit(as_of)), LIVE_DAYS)


def live(events: DataFrame, as_of: str) -> DataFrame:
    return events.filter(F.col("ts") >= cutoff(as_of))


def leaving(events: DataFrame, as_of: str, cap: int | None = None) -> DataFrame:
    """Rows that leave the live window: those before the cutoff and, only if a cap is given, the oldest of the rest beyond `cap` rows. Rows without a
    time do not leave."""
    old = events.filter(F.col("ts") < cutoff(as_of))
    rest = live(events, as_of)
    last = bound(rest, cap) if cap is not None else None
    return old.unionByName(rest.filter(~within(last))) if last else old


def newest(events: DataFrame, cap: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("arrival_seq")).limit(cap)


def bound(events: DataFrame, cap: int) -> Row | None:
    """(ts, arrival_seq) of the cap-th newest row; None if there are no more rows than the cap. Without a row to keep, the newest time of all."""
    if cap <= 0:
        top = events.agg(F.max("ts").alias("ts")).first()
        return Row(ts=top.ts, arrival_seq=None, none=True) if top.ts else None
    found = newest(events.select("ts", "arrival_seq"), cap).agg(F.count("*").alias("n"), F.min(F.struct("ts", "arrival_seq")).alias("last")).first()
    return Row(ts=found.last.ts, arrival_seq=found.last.arrival_seq, none=False) if found.n == cap else None


def within(last: Row) -> Column:
    """Whether a row is no older than a bound; rows that tie with it stay, and rows without a time do."""
    if last.none:
        return F.col("ts").isNull()
    at, seq = F.lit(last.ts), F.lit(last.arrival_seq).cast("long")
    later = F.col("arrival_seq").isNotNull() & (seq.isNull() | (F.col("arrival_seq") >= seq))
    return F.col("ts").isNull() | (F.col("ts") > at) | ((F.col("ts") == at) & (later | (seq.isNull() & F.col("arrival_seq").isNull())))


def trim(events: DataFrame, history: DataFrame, as_of: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(live rows, history with the folds of the rows that left). Each row may be folded once: streaming.store's trim keeps both in one version."""
    rest = live(events, as_of)
    last = bound(rest, cap) if cap is not None else None
    return rest.filter(within(last)) if last else rest, merge_history(history, day_fold(leaving(events, as_of, cap)))


def backfill_from(watermark: str | None, as_of: str) -> Column:
    """Where a backfill starts: the watermark, at most BACKFILL_DAYS before as_of."""
    furthest = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {BACKFILL_DAYS} days")
    return F.greatest(F.lit(watermark).cast("timestamp_ntz"), furthest)  # a null watermark bounds nothing


def backfill(events: DataFrame, watermark: str | None, as_of: str) -> DataFrame:
    """Strongest rows from the start of the backfill up to the cutoff, which history does not hold yet. Later than that is live, earlier
    is ignored."""
    return events.filter((F.col("ts") >= backfill_from(watermark, as_of)) & (F.col("ts") < cutoff(as_of)))


def advanced(watermarks: DataFrame, seen: DataFrame) -> DataFrame:
    """watermarks(collector, complete_through), each at what seen(collector, complete_through) has of it at least; none ever goes back."""
    return watermarks.unionByName(seen.select("collector", F.col("complete_through").cast("timestamp_ntz").alias("complete_through"))).groupBy("collector").agg(F.max("complete_through").alias("complete_through"))


def advance(watermarks: DataFrame, collector: str, through: Column) -> DataFrame:
    """watermarks with the collector's at `through` at least."""
    return advanced(watermarks, watermarks.sparkSession.range(1).select(F.lit(collector).alias("collector"), through.alias("complete_through")))


def frontier(progress: DataFrame, read: DataFrame) -> DataFrame:
    """(collector, complete_through): how far each collector is complete by what its source has consumed. progress(collector, path, consumed, size) has
    a row for each file, read(path, ts) the rows read. A file that lags (consumed < size) holds its collector back at its own last time, or, if
    nothing of it has been read, altogether (null); if none lags it is the last time of all."""
    last = read.groupBy("path").agg(F.max("ts").cast("timestamp_ntz").alias("last"))
    files = progress.join(last, "path", "left").withColumn("lags", F.col("consumed") < F.col("size"))
    held = F.min(F.when(F.col("lags"), F.col("last")))
    through = F.when(F.bool_or(F.col("lags") & F.col("last").isNull()), None).when(F.bool_or("lags"), held).otherwise(F.max("last"))
    return files.groupBy("collector").agg(through.alias("complete_through"))


def apply_late(history: DataFrame, watermarks: DataFrame, late: DataFrame, as_of: str) -> DataFrame:
    """history with late rows (collector, ts, ...) whose day is frozen but not yet covered by their collector's watermark."""
    open_ = late.join(watermarks, "collector", "left")
    own = open_.filter((F.col("ts") < cutoff(as_of)) & (F.col("ts") >= F.coalesce("complete_through", F.lit("1970-01-01").cast("timestamp_ntz"))))
    return merge_history(history, day_fold(own))
