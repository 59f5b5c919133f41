"""Service status pages: affected components, effective indicator, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import by_time, previous

#: Severity of an indicator, and incident states that are over.
RANKS = {"critical": 3, "major": 2, "minor": 1}
OVER = ("resolved", "postmortem")
SCHEMA = "status struct<indicator:string,description:string>, components array<struct<id:string,name:string,status:string,group:boolean>>, incidents array<struct<id:string,name:string,status:string,incident_updates:array<struct<body:string>>>>"


def parse(raw: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """raw(service, json) with affected components, open incidents and the indicator that counts: none if nothing is left."""
    o = raw.withColumn("o", F.from_json("json", SCHEMA)).select("service", "o.*")
    bad = F.filter("components", lambda c: (c["status"] != "operational") & ~F.coalesce(c["group"], F.lit(False)) & ~c["name"].isin(*(excluded or ("",))))
    live = F.filter("incidents", lambda i: ~i["status"].isin(*OVER))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    kept = o.select("service", F.col("status.indicator").alias("indicator"), bad.alias("components"), live.alias("incidents"))
    return kept.withColumn("effective", F.when(none("components") & none("incidents"), "none").otherwise(F.coalesce("indicator", F.lit("none"))))


def shown(parsed: DataFrame) -> DataFrame:
    """At most two incidents, with their newest update, and three components of each service, in feed order."""
    news = F.transform(F.slice("incidents", 1, 2), lambda i: F.concat_ws(": ", i["name"], F.try_element_at(i["incident_updates"], F.lit(1))["body"]))
    return parsed.select("service", "effective", F.coalesce(news, F.array().cast("array<string>")).alias("news"), F.coalesce(F.transform(F.slice("components", 1, 3), lambda c: c["name"]), F.array().cast("array<string>")).alias("affected"))


def rank(indicator: Column) -> Column:
    out = F.lit(0)
    for name, r in RANKS.items():
        out = F.when(indicator == name, r).otherwise(out)
    return out


def worst(parsed: DataFrame) -> DataFrame:
    return parsed.filter("effective <> 'none'").orderBy(F.desc(rank(F.col("effective"))), "service").select("service", "effective").limit(1)


def changes(history: DataFrame) -> DataFrame:
    """history(service, ts, arrival_seq, indicator): rows whose indicator differs from the one before; never the first. On equal
    times the earlier arrival comes first."""
    found = previous(history.filter("indicator is not null"), ["service"], F.to_date("ts"), by_time(history), F.col("indicator"), "before")
    return found.filter("before is not null and before <> indicator")


def significant(snapshots: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """snapshots(key, ts, arrival_seq, ...) without rows that only repeat what the row before of that key said in `fields`."""
    found = previous(snapshots, [key], F.to_date("ts"), by_time(snapshots), F.xxhash64(*fields), "_last")
    return found.filter(F.col("_last").isNull() | (F.col("_last") != F.xxhash64(*fields))).drop("_last")


#: An indicator's colour.
COLOURS = {"none": "green", "minor": "yellow", "major": "orange", "critical": "red"}


def colour(indicator: Column) -> Column:
    out = F.lit("gray")
    for name, c in COLOURS.items():
        out = F.when(indicator == name, c).otherwise(out)
    return out
