"""What is stored of calls that no log can give again: a journal of events and the daily history.

Both are folders of versions (versions.py): what a version names is never changed, so a journal or history can be read, changed and written in one
place, a write that is cut off leaves what was there, and days and watermarks of a history change together. streaming.store keeps the same in one
folder with the live calls; these are for journals and histories of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import performance, retention
from .operators.reconcile import strongest_keyed
from .schema import USAGE_EVENT
from .sources import parse
from .versions import Versions

#: Fixed value: the version that journal lines carry.
VERSION = 2


def journal_lines(events: DataFrame) -> DataFrame:
    """One JSON line {schema, key, event} for each event."""
    event = F.struct(*[c for c in events.columns if c != "dedup_key"])
    return events.select(F.to_json(F.struct(F.lit(VERSION).alias("schema"), F.col("dedup_key").alias("key"), event.alias("event")), {"timestampFormat": parse.MICROS}).alias("value"))


def append_journal(events: DataFrame, folder: str) -> None:
    """Adds lines to the journal."""
    versions = Versions(events.sparkSession, folder)
    state = versions.latest()
    versions.commit(state, add={"lines": {"all": versions.write_text(state, journal_lines(events), "lines")}})


def _journal(spark: SparkSession, folder: str) -> DataFrame:
    """Every event of the journal, with USAGE_EVENT's columns; lines that do not decode are left out."""
    versions = Versions(spark, folder)
    held = versions.folders(versions.latest(), "lines")
    text = spark.read.text(held) if held else spark.createDataFrame([], "value string")
    lines = text.select(F.col("value").alias("line"), F.lit(0).cast("long").alias("byte_offset"))
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in USAGE_EVENT.replace("\n", " ").split(",") if not f.strip().startswith("dedup_key"))
    return parse.journal(lines, fields).drop("seq").withColumnRenamed("key", "dedup_key")


def load_journal(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """The strongest event of each key within the live window. A journal line has a key, so the lines are read once."""
    return strongest_keyed(retention.live(_journal(spark, folder), as_of))


def compact_journal(spark: SparkSession, folder: str, into: str | None = None) -> None:
    """Writes the strongest event of each key, by time (ranges of time over files, sorted within each), in the place of all that is there, or as
    another folder's journal. Events of any age stay, so none is lost that history does not hold yet. The version before stays readable until the next
    compaction."""
    best = journal_lines(strongest_keyed(_journal(spark, folder)).orderBy("ts", "arrival_seq"))
    versions = Versions(spark, into or folder)
    state = versions.latest()
    versions.commit(state, put={"lines": {"all": versions.write_text(state, best, "lines")}})
    versions.remove_unused()


def write_history(days: DataFrame, watermarks: DataFrame, folder: str) -> None:
    """Day aggregates by day, and how far each collector is complete, in one version in the place of the one before. Both may have been read from the same
    folder."""
    versions = Versions(days.sparkSession, folder)
    state = versions.latest()
    held = {t: dict.fromkeys(parts) for t, parts in state["tables"].items()}
    new = {"days": versions.write(state, days.withColumn("part", F.col("day").cast("string")), "days", "part"), "watermarks": versions.write(state, watermarks.withColumn("part", F.lit("all")), "watermarks", "part")}
    versions.commit(state, put={t: held.get(t, {}) | parts for t, parts in new.items()})


def load_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(day aggregates, watermarks)."""
    versions = Versions(spark, folder)
    state = versions.latest()
    schema = "day date, provider string, input long, output long, cache long, reasoning long, calls long"
    return versions.read(versions.folders(state, "days"), schema), versions.read(versions.folders(state, "watermarks"), retention.WATERMARK)


VALUES = "provider string, model string, metric string, value double, n long"


def write_day_values(events: DataFrame, folder: str) -> None:
    """Counted values of the days of events (operators.performance.day_values), in the place of what is there of these days."""
    versions = Versions(events.sparkSession, folder)
    state = versions.latest()
    versions.commit(state, put={"values": versions.write(state, performance.day_values(events).withColumn("part", F.col("day").cast("string")).drop("day"), "values", "part")})


def load_day_values(spark: SparkSession, folder: str, first: str, last: str) -> DataFrame:
    """Counted values of the days from first to last (yyyy-mm-dd); no other day's files are read."""
    versions = Versions(spark, folder)
    state = versions.latest()
    return versions.read(versions.folders(state, "values", [d for d in state["tables"].get("values", {}) if first <= d <= last]), VALUES)
