"""One stored row for each call, kept by micro-batches: strongest-wins upserts, what they change, totals, history and its watermarks.

Everything is in one folder of versions (versions.py), so a micro-batch, a trim or a compaction is there whole or not at all. Tables:

| table | by | rows |
| --- | --- | --- |
| rows | day of ts | a row for each time a call's stored row changed; `gone` where it left the day; the largest seq counts |
| keys | hash of the key | the same changes with what a later batch must know: day, strength, and the measures that totals hold |
| hidden | day | keys of calls that another collector's row explains (shadowed) |
| changes | version | what each version took out of the visible calls (sign -1) and put in (sign 1) |
| hours | day | sums of the changes by hour and provider |
| history | day | sums of calls that left the live window, by day and provider |

A batch reads the files of its keys' buckets, and no rows at all: a row that is stronger than the stored one is added, with a mark in the
day that the call left, and its change is the difference of measures. All tables but the first version's grow by additions; compact() makes one folder of
a partition's. A version holds the last batch of each stream, so a batch that comes again changes nothing, whatever has been compacted since."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import retention
from ..operators.reconcile import strength, strongest_keyed, strongest_per_key
from ..operators.usage import day_fold
from ..scratch import written
from ..versions import NONE, Versions

#: Parts of the key index; a store of billions of keys wants thousands.
BUCKETS = 16
#: What totals hold of a call.
MEASURES = ("input_tokens", "output_tokens", "cache", "reasoning")
SUMS = ("input", "output", "cache", "reasoning", "calls")
KEYS = "dedup_key string, seq long, day date, ts timestamp_ntz, provider string, input_tokens long, output_tokens long, cache long, reasoning long, hidden boolean, strength struct<a:int,b:int,c:long,d:int,e:long>"
STRENGTH = (("a", "int"), ("b", "int"), ("c", "long"), ("d", "int"), ("e", "long"))
CHANGES = "sign int, dedup_key string, ts timestamp_ntz, provider string, input_tokens long, output_tokens long, cache long, reasoning long"
HOURS = "hour timestamp_ntz, provider string, input long, output long, cache long, reasoning long, calls long"
HISTORY = "day date, provider string, input long, output long, cache long, reasoning long, calls long"
HIDDEN = "dedup_key string"


def _day_name(day: Column) -> Column:
    return day.cast("string")  # a null day is the partition NONE


def _measured(rows: DataFrame, *more: Column) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    s = strength()
    return rows.select(
        "dedup_key", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp_ntz").alias("ts"), "provider", zero("input_tokens").alias("input_tokens"), zero("output_tokens").alias("output_tokens"),
        (zero("cache_read") + zero("cache_create")).alias("cache"), zero("reasoning").alias("reasoning"), (F.coalesce("shadowed", F.lit(False)) if "shadowed" in rows.columns else F.lit(False)).alias("came_hidden"), F.struct(*[s.getField(f"col{i + 1}").cast(t).alias(n) for i, (n, t) in enumerate(STRENGTH)]).alias("strength"), *more,
    )


def _sums(changes: DataFrame) -> list[Column]:
    return [F.sum(F.col("sign") * F.col(c)).alias(s) for c, s in zip(MEASURES, SUMS, strict=False)] + [F.sum("sign").cast("long").alias("calls")]


class Store:
    """Calls in a folder; batches have the columns of usage events. buckets is fixed by the first batch."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.versions, self._buckets = spark, Versions(spark, folder), buckets

    # What is stored ------------------------------------------------------------------------------

    def _schema(self, state: dict) -> StructType:
        return StructType.fromJson(state["values"]["schema"])

    def rows(self, days: list[str] | None = None, state: dict | None = None) -> DataFrame:
        """The stored calls, with day and shadowed, of the named days or all. Days of one folder need no look at earlier changes."""
        state = state or self.versions.latest()
        if "schema" not in state["values"]:
            raise FileNotFoundError(self.versions.folder)
        held = state["tables"].get("rows", {})
        wanted = [d for d in (held if days is None else days) if d in held]
        parts = lambda many: self.versions.read(self.versions.folders(state, "rows", [d for d in wanted if (len(held[d]) > 1) == many]), self._schema(state))
        newest = F.row_number().over(W.partitionBy("day", "dedup_key").orderBy(F.desc("seq")))
        many = parts(True)
        last = many.filter("dedup_key is not null").withColumn("_n", newest).filter("_n = 1").drop("_n").unionByName(many.filter("dedup_key is null"))
        found = parts(False).unionByName(last).filter("not gone").drop("gone", "seq")
        folders = self.versions.folders(state, "hidden", wanted)
        if not folders:
            return found.withColumn("shadowed", F.lit(False))
        hidden = self.versions.read(folders, HIDDEN).distinct().withColumn("shadowed", F.lit(True))
        return found.join(hidden, "dedup_key", "left").withColumn("shadowed", F.coalesce("shadowed", F.lit(False)))

    def _known(self, state: dict, keys: DataFrame) -> DataFrame:
        """What the index has of the calls in keys(dedup_key, bucket), from their buckets' files alone."""
        buckets = [r.bucket for r in keys.filter("bucket is not null").select(F.col("bucket").cast("string").alias("bucket")).distinct().collect()]  # at most the store's buckets
        found = self.versions.read(self.index_files(state, buckets), KEYS).join(keys.select("dedup_key"), "dedup_key", "left_semi")
        live = state["values"].get("live_from")
        found = found.filter(F.col("day").isNull() | (F.col("day") >= F.lit(live).cast("date"))) if live else found
        return found.withColumn("_n", F.row_number().over(W.partitionBy("dedup_key").orderBy(F.desc("seq")))).filter("_n = 1").drop("_n")

    def index_files(self, state: dict, buckets: list[str]) -> list[str]:
        return self.versions.folders(state, "keys", buckets)

    def hours(self) -> DataFrame:
        """(hour, provider, ...) sums of the visible live calls; hours whose calls have all left are not there."""
        return self._total(self.versions.latest(), "hours", HOURS, ["hour", "provider"])

    def days(self) -> DataFrame:
        """(day, provider, ...) sums of the visible live calls, from the hours."""
        return self.hours().groupBy(F.to_date("hour").alias("day"), "provider").agg(*[F.sum(c).alias(c) for c in SUMS])

    def history(self) -> DataFrame:
        """(day, provider, ...) sums of what has left the live window."""
        return self._total(self.versions.latest(), "history", HISTORY, ["day", "provider"])

    def _total(self, state: dict, table: str, schema: str, by: list[str]) -> DataFrame:
        return self.versions.read(self.versions.folders(state, table), schema).groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("calls <> 0")

    def changes(self, after: int = -1) -> DataFrame:
        """(version, sign, ...) of the versions after `after`."""
        state = self.versions.latest()
        parts = [v for v in state["tables"].get("changes", {}) if int(v) > after]
        return self.versions.read(self.versions.folders(state, "changes", parts), f"version long, {CHANGES}")

    def watermarks(self) -> dict[str, str]:
        """How far each collector's history is complete."""
        return self.versions.latest()["values"].get("complete_through", {})

    # What changes it -----------------------------------------------------------------------------

    def upsert(self, stream: str = "events") -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: the strongest row of each key stays. Rows without a key are calls of their own. Rows from before the live
        window are left to late()."""

        def run(batch: DataFrame, number: int) -> None:
            state = self.versions.latest()
            if state["streams"].get(stream, -1) >= number:
                return
            self._add(state, batch, {stream: number})

        return run

    def _add(self, state: dict, batch: DataFrame, streams: dict[str, int]) -> None:
        v = state["version"] + 1
        arrived = written(batch.drop("day"), "arrived", self.spark)
        live = state["values"].get("live_from")
        inside = F.col("ts").isNull() | (F.col("ts") >= F.lit(live).cast("date")) if live else F.lit(True)
        row = F.struct(*[c for c in arrived.columns if c != "shadowed"]).alias("row")
        # whole rows cross one exchange by key, where the strongest is found and meets what is known of it
        new = _measured(strongest_keyed(arrived).filter(inside), row)
        old = self._known(state, arrived.select("dedup_key").withColumn("bucket", self._bucket(state))).select(*[F.col(c).alias(f"old_{c}") for c in StructType.fromDDL(KEYS).names])
        met = new.join(old, F.col("dedup_key") == F.col("old_dedup_key"), "left")
        met = met.unionByName(_measured(arrived.filter("dedup_key is null").filter(inside), row), allowMissingColumns=True).withColumn("bucket", self._bucket(state))
        won = met.filter(F.col("old_strength").isNull() | (F.col("strength") > F.col("old_strength"))).withColumn("hidden", F.coalesce("old_hidden", F.lit(False)) | F.col("came_hidden"))
        newly, seen = F.expr("hidden and dedup_key is not null and (not coalesce(old_hidden, false) or not (day <=> old_day))"), Observation()
        won = written(won.observe(seen, F.count_if(newly).alias("n")), "won")
        stored = won.select("row.*")
        stored = stored.withColumns({"seq": F.lit(v).cast("long"), "gone": F.lit(False), "day": F.to_date("ts")})
        moved = won.filter("old_strength is not null and not (day <=> old_day)")
        left = moved.select(F.col("old_dedup_key").alias("dedup_key"), F.col("old_day").alias("day"), F.lit(v).cast("long").alias("seq"), F.lit(True).alias("gone"))
        schema = state["values"].get("schema") or stored.schema.jsonValue()
        both = stored.unionByName(left, allowMissingColumns=True).select(*StructType.fromJson(schema).names)
        index = won.filter("dedup_key is not null").withColumn("seq", F.lit(v).cast("long")).select("bucket", *StructType.fromDDL(KEYS).names)
        out = won.filter("old_strength is not null and not old_hidden").select(F.lit(-1).alias("sign"), F.col("old_dedup_key").alias("dedup_key"), *[F.col(f"old_{c}").alias(c) for c in ("ts", "provider", *MEASURES)])
        changes = out.unionByName(won.filter("not hidden").select(F.lit(1).alias("sign"), "dedup_key", "ts", "provider", *MEASURES))
        writes = {"rows": lambda: self.versions.write(state, both.withColumn("part", _day_name(F.col("day"))), "rows", "part"), "keys": lambda: self.versions.write(state, index, "keys", "bucket")}
        if seen.get["n"]:
            hidden = won.filter(newly).select("dedup_key", _day_name(F.col("day")).alias("part"))
            writes["hidden"] = lambda: self.versions.write(state, hidden, "hidden", "part")
        self._commit(state, changes, writes, streams, {"schema": schema, "buckets": state["values"].get("buckets", self._buckets)})

    def _commit(self, state: dict, changes: DataFrame, writes: dict[str, Callable[[], dict]], streams: dict[str, int], values: dict | None = None) -> None:
        """Writes the tables at once, and the changes with their sums by hour, and makes the version."""

        def changed() -> dict:
            v = state["version"] + 1
            told = self.versions.write(state, changes.withColumns({"version": F.lit(v).cast("long"), "part": F.lit(f"{v:012d}")}), "changes", "part", one=True)
            seen = self.versions.read([f"{self.versions.folder}/{f}" for f in told.values()], CHANGES)
            return {"changes": told, "hours": self._hours(state, seen)}

        with ThreadPoolExecutor(len(writes) + 1) as pool:  # Spark runs their jobs side by side
            last, others = pool.submit(changed), {t: pool.submit(w) for t, w in writes.items()}
            add = {t: f.result() for t, f in others.items()} | last.result()
        self.versions.commit(state, add=add, streams=streams, values=values)

    def _hours(self, state: dict, changes: DataFrame) -> dict[str, str]:
        hours = changes.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "provider").agg(*_sums(changes)).filter(" or ".join(f"{c} <> 0" for c in SUMS))
        return self.versions.write(state, hours.withColumn("part", _day_name(F.to_date("hour"))), "hours", "part")

    def _bucket(self, state: dict) -> Column:
        return F.when(F.col("dedup_key").isNotNull(), F.pmod(F.xxhash64("dedup_key"), F.lit(state["values"].get("buckets", self._buckets))))

    def hide(self, keys: DataFrame, stream: str | None = None, number: int = 0) -> None:
        """Marks calls of keys(dedup_key) as shadowed: stored ones leave the totals and stay in rows; others will be hidden when they come. Keys that are
        hidden already change nothing; nor does a number that came before."""
        state = self.versions.latest()
        if stream and state["streams"].get(stream, -1) >= number:
            return
        seq = F.lit(state["version"] + 1).cast("long")
        asked = written(keys.select("dedup_key").filter("dedup_key is not null").distinct().withColumn("bucket", self._bucket(state)), "asked")
        known = self._known(state, asked)
        found = written(asked.join(known.select(F.col("dedup_key").alias("_key"), *[c for c in known.columns if c != "dedup_key"]), F.col("dedup_key") == F.col("_key"), "left").drop("_key").filter("not coalesce(hidden, false)"), "found")
        stored = found.filter("strength is not null")
        writes = {"keys": lambda: self.versions.write(state, found.withColumns({"hidden": F.lit(True), "seq": seq}), "keys", "bucket"), "hidden": lambda: self.versions.write(state, stored.select("dedup_key", _day_name(F.col("day")).alias("part")), "hidden", "part")}
        self._commit(state, stored.select(F.lit(-1).alias("sign"), "dedup_key", "ts", "provider", *MEASURES), writes, {stream: number} if stream else {}, {"buckets": state["values"].get("buckets", self._buckets)})

    def hidden_among(self, keys: DataFrame) -> DataFrame:
        """Those of keys(dedup_key) that are hidden."""
        state = self.versions.latest()
        if not state["tables"].get("keys"):
            return self.spark.createDataFrame([], HIDDEN)
        asked = written(keys.select("dedup_key").distinct().withColumn("bucket", self._bucket(state)), "asked")
        return self._known(state, asked).filter("hidden").select("dedup_key")

    def trim(self, as_of: str, cap: int | None = None) -> None:
        """Folds what leaves the live window into history and takes it out, in one version: done again it changes nothing. With a cap also the oldest
        rows beyond it leave (retention.within); their keys stay known, so that they do not come back."""
        state = self.versions.latest()
        if "schema" not in state["values"]:
            return
        cut = str(self.spark.range(1).select(retention.cutoff(as_of)).first()[0])
        cut = max(cut, state["values"].get("live_from", cut))
        held = state["tables"].get("rows", {})
        old = [d for d in held if d != NONE and d < cut]
        put: dict = {"rows": dict.fromkeys(old), "hidden": dict.fromkeys(old), "hours": dict.fromkeys(old)}
        left, add, less = self.rows(old, state), {}, None
        live = [d for d in held if d != NONE and d >= cut]
        bound = retention.bound(self.rows(live, state), cap) if cap is not None and live else None
        if bound:
            days = [d for d in live if d <= str(bound.ts.date())]
            rows = self.rows(days, state)
            over = written(rows.filter(~retention.within(bound)), "over")
            if not over.isEmpty():
                left = left.unionByName(over)
                schema, live_keys = self._schema(state), over.select("dedup_key").filter("dedup_key is not null").withColumn("bucket", self._bucket(state))
                rest = rows.filter(retention.within(bound)).drop("shadowed").withColumns({"seq": F.lit(state["version"] + 1).cast("long"), "gone": F.lit(False)}).select(*schema.names)
                put["rows"] |= dict.fromkeys(days) | self.versions.write(state, rest.withColumn("part", _day_name(F.col("day"))), "rows", "part")
                top = F.struct(*[F.lit((1 << 31) - 1).cast(t).alias(n) for n, t in STRENGTH])
                known = self._known(state, live_keys).withColumns({"seq": F.lit(state["version"] + 1).cast("long"), "hidden": F.lit(True), "strength": top, "bucket": self._bucket(state)})
                add["keys"] = self.versions.write(state, known, "keys", "bucket")
                less = _measured(over.filter("not shadowed")).select(F.lit(-1).alias("sign"), "dedup_key", "ts", "provider", *MEASURES)
        if old or less is not None:
            add["history"] = self.versions.write(state, day_fold(left).withColumn("part", _day_name(F.col("day"))), "history", "part")
            if less is not None:
                add["hours"] = self._hours(state, less)
            self.versions.commit(state, add=add, put=put, values={"live_from": cut})

    def late(self, rows: DataFrame, stream: str, number: int, through: dict[str, str]) -> None:
        """Folds rows(collector, ts, ...) of frozen days, which no watermark of their collector covers yet, into history and moves the watermarks to
        `through` at least, in one version; a number that came before changes nothing."""
        state = self.versions.latest()
        live = state["values"].get("live_from")
        if live is None or state["streams"].get(stream, -1) >= number:
            return
        marks = state["values"].get("complete_through", {})
        known = self.spark.createDataFrame(list(marks.items()), "collector string, complete_through string").selectExpr("collector", "cast(complete_through as timestamp_ntz) as complete_through")
        own = rows.join(F.broadcast(known), "collector", "left").filter((F.col("ts") < F.lit(live).cast("date")) & (F.col("ts") >= F.coalesce("complete_through", F.lit("1970-01-01").cast("timestamp_ntz"))))  # a row for each collector
        fold = day_fold(strongest_per_key(own.drop("complete_through"))).withColumn("part", _day_name(F.col("day")))
        newer = marks | {c: max(t, marks.get(c, t)) for c, t in through.items()}
        self.versions.commit(state, add={"history": self.versions.write(state, fold, "history", "part")}, streams={stream: number}, values={"complete_through": newer})

    def compact(self, folders: int = 2, changes_before: int | None = None) -> None:
        """Makes one folder of each partition that has `folders` or more; changes of versions before the given one are forgotten."""
        state = self.versions.latest()
        many = lambda table: [p for p, held in state["tables"].get(table, {}).items() if len(held) >= folders]
        put: dict = {}
        if days := many("rows"):
            schema = self._schema(state)
            rows = self.rows(days, state).drop("shadowed").withColumns({"seq": F.lit(state["version"]).cast("long"), "gone": F.lit(False)}).select(*schema.names)
            put["rows"] = dict.fromkeys(days) | self.versions.write(state, rows.withColumn("part", _day_name(F.col("day"))), "rows", "part")
        if buckets := many("keys"):
            every = self.versions.read(self.index_files(state, buckets), KEYS)
            last = every.withColumn("_n", F.row_number().over(W.partitionBy("dedup_key").orderBy(F.desc("seq")))).filter("_n = 1").drop("_n")
            live = state["values"].get("live_from")
            last = last.filter(F.col("day").isNull() | (F.col("day") >= F.lit(live).cast("date"))) if live else last
            put["keys"] = dict.fromkeys(buckets) | self.versions.write(state, last.withColumn("bucket", self._bucket(state)), "keys", "bucket")
        for table, schema, by in (("hours", HOURS, ["hour", "provider"]), ("history", HISTORY, ["day", "provider"])):
            if days := many(table):
                part = {"tables": {table: {d: state["tables"][table][d] for d in days}}}
                put[table] = dict.fromkeys(days) | self.versions.write(state, self._total(part, table, schema, by).withColumn("part", _day_name(F.to_date(by[0]))), table, "part")
        if days := many("hidden"):
            held = self.spark.createDataFrame([], f"{HIDDEN}, part string")
            for d in days:  # a day's keys come from its own folders
                held = held.unionByName(self.versions.read(self.versions.folders(state, "hidden", [d]), HIDDEN).distinct().withColumn("part", F.lit(None if d == NONE else d).cast("string")))
            put["hidden"] = dict.fromkeys(days) | self.versions.write(state, held, "hidden", "part")
        if changes_before is not None:
            put["changes"] = {v: None for v in state["tables"].get("changes", {}) if int(v) < changes_before}
        if any(put.values()):
            self.versions.commit(state, put=put)
