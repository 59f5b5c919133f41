"""Queries over what is kept: journal, history, the live window, upserts by batch, and duplicates as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..operators import arrival, performance, retention, usage
from ..scratch import scratch
from ..sources import collect, lines, parse
from ..sources.adapter import AS_OF, usage_events
from ..streaming import upsert
from ..streaming.store import Store
from .registry import query

US = F.unix_micros
#: A day in the events' middle, so that some days are frozen then.
LATER = "2024-02-14 12:00:00"
CUT = "date '2024-02-14' - interval 31 day"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call as a running row six hours before, the call, and for some a weaker late copy."""
    x = usage_events(spark, sf_dir)
    partial = x.withColumns({"output_tokens": F.lit(0).cast("long"), "status": F.lit("running"), "ts": F.expr("ts - interval 6 hours"), "arrival_seq": F.col("arrival_seq") * 3})
    late = x.filter("output_tokens % 2 = 0").withColumns({"token_accuracy": F.lit("unknown"), "ts": F.expr("ts + interval 30 hours"), "arrival_seq": F.col("arrival_seq") * 3 + 2})
    return partial.unionByName(x.withColumn("arrival_seq", F.col("arrival_seq") * 3 + 1)).unionByName(late)


def _stored(spark: SparkSession, sf_dir: str, batches: int = 3) -> Store:
    """The observations in micro-batches, the second of them given twice, with a compaction between two batches."""
    rows, store = _observed(spark, sf_dir), Store(spark, scratch(spark, "calls"))
    run = store.upsert()
    for number, part in ((0, 0), (1, 1), (1, 1), *((n, n) for n in range(2, batches))):
        run(rows.filter(F.pmod(F.col("arrival_seq") * 7, F.lit(batches)) == part), number)
        if number == 1:
            store.compact()
    return store


query("upsert_replay", "select dedup_key, ts, cast(ts as date) as day, token_accuracy, status, output_tokens from x")(lambda s, d: _stored(s, d, 4).rows().select("dedup_key", "ts", "day", "token_accuracy", "status", "output_tokens"))
HOUR = "select date_trunc('hour', ts) as hour, provider, cast(sum(input_tokens) as bigint) as input, cast(sum(output_tokens) as bigint) as output, cast(sum(cache_read + cache_create) as bigint) as cache, cast(sum(reasoning) as bigint) as reasoning, count(*) as calls from x group by 1, 2"
query("store_hours", HOUR)(lambda s, d: _stored(s, d).hours())
SIGNED = "select dedup_key, epoch_us(ts) as ts_us, provider, output_tokens, cast(1 as bigint) as n from x"
query("store_changes", SIGNED)(lambda s, d: _stored(s, d).changes().groupBy("dedup_key", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("ts_us"), "provider", "output_tokens").agg(F.sum("sign").alias("n")).filter("n <> 0"))


def _hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that others explain, some of them told twice and some before they come; a later batch does not bring them back."""
    x, store = usage_events(spark, sf_dir), Store(spark, scratch(spark, "calls"))
    store.upsert()(x.filter("arrival_seq % 4 > 0").withColumn("token_accuracy", F.lit("unknown")), 0)
    for rows in ("arrival_seq % 5 = 0 and provider = 'ollama'", "arrival_seq % 5 = 0"):
        store.hide(x.filter(rows).select("dedup_key"))
    store.upsert()(x, 1)
    return store.days()


HIDE = "select * from x where arrival_seq % 5 <> 0"
query("store_hidden", f"with v as ({HIDE}) select cast(ts as date) as day, provider, cast(sum(input_tokens) as bigint) as input, cast(sum(output_tokens) as bigint) as output, cast(sum(cache_read + cache_create) as bigint) as cache, cast(sum(reasoning) as bigint) as reasoning, count(*) as calls from v group by 1, 2")(_hidden)

# Journal and history ------------------------------------------------------------------------------------------------------------


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two parts with partial rows before, loaded, compacted into another folder, and loaded again."""
    rows, folder, into = collect.as_usage_events(_observed(spark, sf_dir).filter("arrival_seq % 3 < 2")), scratch(spark, "journal"), scratch(spark, "compacted")
    sinks.append_journal(rows.filter("status = 'running'"), folder)
    sinks.append_journal(rows.filter("status <> 'running'"), folder)
    sinks.compact_journal(spark, folder, into)
    return sinks.load_journal(spark, into, LATER).select("dedup_key", US("ts").alias("ts_us"), "provider", "source", "model", "input_tokens", "output_tokens", "token_accuracy", "status", "duration_s")


query("journal_round_trip", f"select dedup_key, epoch_us(ts) as ts_us, provider, source, model, input_tokens, output_tokens, token_accuracy, status, duration_s from x where ts >= {CUT}")(_journal)


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = usage_events(spark, sf_dir).filter("source = 'proxy'")
    line = "to_json(named_struct('ts', cast(unix_micros(cast(ts as timestamp)) div 1000000 as double), 'model', model, 'input', input_tokens, 'output', output_tokens, 'cacheR', cache_read + {more}, 'cacheC', cache_create))"
    each = x.selectExpr("arrival_seq", f"posexplode(array({line.format(more=5)}, {line.format(more=0)}, if(arrival_seq % 5 = 0, '{{\"ts\":1', null))) as (k, line)").filter("line is not null")
    made = each.selectExpr("'/j' as path", "arrival_seq * 10 + k as byte_offset", "line", "cast(null as timestamp) as mtime")
    return parse.legacy_journal(made).select(US("ts").alias("ts_us"), "model", "input_tokens", "output_tokens", "cache_read", "token_accuracy")


query("legacy_journal", "with p as (select *, epoch_us(ts) // 1000000 as sec from x where source = 'proxy') select sec * 1000000 as ts_us, model, input_tokens, output_tokens, arg_max(cache_read, arrival_seq) as cache_read, 'unknown' as token_accuracy from p group by sec, model, input_tokens, output_tokens")(_legacy)


def _history_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History files of a week each: even days in the present form, odd days in the flat older one."""
    f = usage.day_fold(usage_events(spark, sf_dir)).selectExpr("date_format(day, 'yyyy-MM-dd') as day", "provider", "input", "output", "cache", "reasoning", "calls")
    now = f.filter("cast(right(day, 2) as int) % 2 = 0").selectExpr("day", "concat('\"', provider, '\":', to_json(struct(input, output, cache, reasoning, calls))) as part")
    flat = "concat('\"', {n}, 'In\":', input, ',\"', {n}, 'Out\":', output, ',\"', {n}, 'Cache\":', cache)".replace("{n}", "if(provider = 'claudeCode', 'claude', provider)")
    then = f.filter("cast(right(day, 2) as int) % 2 = 1").selectExpr("day", f"{flat} as part")
    by_day = lambda d, before, after: d.groupBy("day").agg(F.array_join(F.collect_list("part"), ",").alias("parts")).selectExpr("day", f"concat('\"', day, '\":{before}', parts, '{after}') as doc")
    days = by_day(now, '{"providers":{', "}}").unionByName(by_day(then, '{"calls":1,', "}"))
    return days.groupBy(F.expr("weekofyear(to_date(day))").alias("week")).agg(F.array_join(F.collect_list("doc"), ",").alias("docs")).selectExpr("concat('{\"days\":{', docs, '}}') as json")


FOLD = "select cast(ts as date) as day, provider, cast(sum(input_tokens) as bigint) as input, cast(sum(output_tokens) as bigint) as output, cast(sum(cache_read + cache_create) as bigint) as cache, cast(sum(reasoning) as bigint) as reasoning, count(*) as calls from x group by 1, 2"
query("history_load", f"with f as ({FOLD}) select day, provider, input, output, cache, case when day(day) % 2 = 0 then reasoning else 0 end as reasoning, case when day(day) % 2 = 0 then calls else 0 end as calls from f where day(day) % 2 = 0 or input > 0 or output > 0 or cache > 0")(lambda s, d: parse.history(_history_json(s, d)))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that leave the live window folded into a history, which is written, read, and given late rows."""
    x, folder = usage_events(spark, sf_dir), scratch(spark, "history")
    none = usage.day_fold(x.limit(0))
    _, history = retention.trim(x.filter("arrival_seq % 9 <> 0"), none, LATER)
    marks = retention.advance(spark.createDataFrame([], retention.WATERMARK), "transcript", F.lit("2024-01-05"))
    marks = retention.advance(retention.advance(marks, "proxy", F.lit("2024-01-03")), "transcript", F.lit("2024-01-02"))
    sinks.write_history(history, marks, folder)
    days, marks = sinks.load_history(spark, folder)
    late = x.filter("arrival_seq % 9 = 0").withColumn("collector", F.col("source"))
    return retention.apply_late(days, marks, late, LATER)


query("history_round_trip", f"with h as (select * from x where ts < {CUT} and (arrival_seq % 9 <> 0 or ts >= case source when 'transcript' then date '2024-01-05' when 'proxy' then date '2024-01-03' else date '1970-01-01' end)) {FOLD.replace('from x', 'from h')}")(_history)


def _trimmed(spark: SparkSession, sf_dir: str, cap: int | None) -> DataFrame:
    """Trimmed twice between batches, compacted, and all observations given again: what has left is in history once, and does not come back."""
    store = _stored(spark, sf_dir)
    for _ in range(2):
        store.trim(LATER, cap)
    store.compact()
    store.upsert()(_observed(spark, sf_dir), 9)
    live, history = store.days(), store.history()
    return history.withColumn("frozen", F.lit(True)).unionByName(live.withColumn("frozen", F.lit(False)))


LEFT = f"(ts < {CUT})"
query("store_trim", f"with h as (select *, {LEFT} as frozen from x) {FOLD.replace('from x', 'from h').replace('as calls', 'as calls, frozen').replace('group by 1, 2', 'group by 1, 2, frozen')}")(lambda s, d: _trimmed(s, d, None))
query("store_trim_capped", f"with h as (select *, {LEFT} or row_number() over (order by ts desc, arrival_seq desc) > 300 as frozen from x) {FOLD.replace('from x', 'from h').replace('as calls', 'as calls, frozen').replace('group by 1, 2', 'group by 1, 2, frozen')}")(lambda s, d: _trimmed(s, d, 300))


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows of frozen days in two batches, given twice: those that their collector's watermark covers by then are refused."""
    x, store = usage_events(spark, sf_dir).withColumn("collector", F.col("source")), Store(spark, scratch(spark, "calls"))
    store.upsert()(x.filter("arrival_seq % 9 <> 0").drop("collector"), 0)
    store.trim(LATER)
    for number in (0, 0, 1, 1):
        store.late(x.filter(f"arrival_seq % 18 = {9 * number}"), "late", number, {"transcript": "2024-01-05 00:00:00", "proxy": "2024-01-03 00:00:00"})
    return store.history()


query("store_late", f"with h as (select * from x where ts < {CUT} and (arrival_seq % 9 <> 0 or arrival_seq % 18 = 0 or ts >= case source when 'transcript' then date '2024-01-05' when 'proxy' then date '2024-01-03' else date '1970-01-01' end)) {FOLD.replace('from x', 'from h')}")(_late)


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each collector has come, advanced by what two halves of the events reach; the second half's earlier times take nothing back."""
    seen = lambda rows: rows.groupBy(F.col("source").alias("collector")).agg(F.max("ts").alias("complete_through"))
    x = usage_events(spark, sf_dir).filter(F.col("ts") < retention.cutoff(LATER))
    return retention.advanced(retention.advanced(spark.createDataFrame([], retention.WATERMARK), seen(x.filter("arrival_seq % 2 = 0"))), seen(x.filter("arrival_seq % 2 = 1")))


query("watermarks", f"select source as collector, max(ts) as complete_through from x where ts < {CUT} group by 1")(_marks)
query("live_window", f"select dedup_key, ts from x where ts >= {CUT}")(lambda s, d: retention.live(usage_events(s, d), LATER).select("dedup_key", "ts"))
query("retention_leaving", f"with k as (select dedup_key, row_number() over (order by ts desc, arrival_seq desc) as n from x where ts >= {CUT}) select dedup_key from x where ts < {CUT} union all select dedup_key from k where n > 300")(lambda s, d: retention.leaving(usage_events(s, d), LATER, 300).select("dedup_key"))
query("backfill_range", f"select dedup_key, ts from x where ts >= timestamp '2024-01-04 06:00:00' and ts < {CUT}")(lambda s, d: retention.backfill(usage_events(s, d), "2024-01-04 06:00:00", LATER).select("dedup_key", "ts"))
query("day_columns", f"""with f as ({FOLD}) select day, {', '.join(f'''cast(coalesce(sum(case when provider = '{p}' then input + output end), 0) as bigint) as "{p}", cast(coalesce(sum(case when provider = '{p}' then input + output + cache end), 0) as bigint) as "{p}_with_cache"''' for p in ('claudeCode', 'codex', 'ollama', 'lmStudio'))},
cast(sum(input + output) as bigint) as total, cast(sum(input + output + cache) as bigint) as total_with_cache, cast(sum(calls) as bigint) as calls from f group by 1""")(lambda s, d: usage.day_columns(usage.day_fold(usage_events(s, d))))

# Duplicates as they arrive: rows of odd arrival are stored, the others come as one batch --------------------------------------------

SPLIT = "b as (select *, epoch_us(ts) as us, arrival_seq % 2 = 0 as came from x where provider = 'ollama')"
MEET = "abs(p.us - t.us) < 90000000 and abs(p.output_tokens - t.output_tokens) <= 2"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = usage_events(spark, sf_dir, True)
    return x.filter("arrival_seq % 2 = 1"), x.filter("arrival_seq % 2 = 0")


query("shadow_on_arrival", f"""with {SPLIT}, t as (select * from b where source = 'transcript' and token_accuracy = 'exact'), p as (select * from b where source = 'proxy'),
m as (select p.dedup_key, row_number() over (partition by t.dedup_key order by p.ts desc, p.dedup_key desc) as n from p, t where not p.came and t.came and {MEET})
select dedup_key from p where came and exists (select 1 from t where {MEET}) union select dedup_key from m where n = 1""", twins=True)(lambda s, d: arrival.shadowed_by_arrival(*_halves(s, d)))
NEAR = "abs(k.us - p.us) < 4000000 and (k.model = p.model or k.model = '')"
query("desktop_on_arrival", f"""with {SPLIT}, k as (select * from b where source = 'ollamaDesktop'), p as (select * from b where source = 'proxy'),
m as (select k.dedup_key, row_number() over (partition by p.dedup_key order by k.ts desc, k.dedup_key desc) as n from k, p where not k.came and p.came and {NEAR})
select dedup_key from k where came and exists (select 1 from p where {NEAR}) union select dedup_key from m where n = 1""", twins=True)(lambda s, d: arrival.desktop_by_arrival(*_halves(s, d)))

# Streams in their batch form ------------------------------------------------------------------------------------------------------

query("tumbling_hours", "select date_trunc('hour', ts) as start, provider, cast(sum(input_tokens + output_tokens) as bigint) as tokens, count(*) as calls from x group by 1, 2")(lambda s, d: upsert.tumbling(usage_events(s, d)).select(F.col("window.start").alias("start"), "provider", "tokens", "calls"))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(spark, sf_dir).filter("provider = 'ollama'").selectExpr("session_id as call_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, cast(arrival_seq * 0.07 as decimal(12, 6))) as ts", "output_tokens")


query("throttled_updates", """with u as (select session_id as call_id, 70000 * arrival_seq as us, output_tokens from x where provider = 'ollama'), s as (select *, us - min(us) over (partition by call_id) as since from u), r as (select *, row_number() over (partition by call_id, case when since = 0 then -1 else since // 200000 end order by us desc) as n from s)
select call_id, us + epoch_us(timestamp '2024-01-01') as us, output_tokens from r where n = 1""")(lambda s, d: upsert.throttled(_updates(s, d)).select("call_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("us"), "output_tokens"))
query("live_display", "select dedup_key as call_id, model, 'chat' as operation, input_tokens + cache_read as input_tokens, case when output_tokens > 0 then output_tokens else arrival_seq % 3 end as output_tokens, case when arrival_seq % 4 = 0 then 'exact' when output_tokens > 0 or arrival_seq % 3 > 0 then 'estimated' else 'unknown' end as output_accuracy from x where source = 'proxy'")(
    lambda s, d: upsert.live_display(usage_events(s, d).filter("source = 'proxy'").selectExpr("dedup_key as call_id", "model", "'chat' as operation", "input_tokens as input", "cache_read", "output_tokens as output", "arrival_seq % 3 as approx_output", "arrival_seq % 4 = 0 as saw_usage", "ts as started_at")).drop("started_at")
)


def _tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of lines, read as byte ranges of 200 bytes: each line once, at its offset."""
    folder = scratch(spark, "tail")
    made = usage_events(spark, sf_dir).selectExpr("concat(dedup_key, ' é ', repeat('x', cast(arrival_seq % 50 as int))) as value")
    made.repartition("value").write.text(folder)
    lines.register(spark)
    found = spark.read.format("offset_lines").option("path", folder).option("glob", "*.txt").option("range_bytes", "2000").load()
    return found.groupBy("line").agg(F.count("*").alias("n"))


query("offset_lines", "select dedup_key || ' é ' || repeat('x', arrival_seq % 50) as line, cast(1 as bigint) as n from x")(_tailed)
query("menu_title", "with t as (select cast(coalesce(sum(input_tokens + output_tokens), 0) as bigint) as n from x where ts >= date '2024-01-30' and ts < date '2024-01-31') select case when n < 1000 then cast(n as varchar) when n < 100000 then concat(cast(((n + 50) // 100) // 10 as varchar), '.', cast(((n + 50) // 100) % 10 as varchar), 'k') when n < 1000000 then concat(cast((n + 500) // 1000 as varchar), 'k') else concat(cast(((n + 5000) // 10000) // 100 as varchar), '.', lpad(cast(((n + 5000) // 10000) % 100 as varchar), 2, '0'), 'M') end as title from t")(
    lambda s, d: usage.menu_title(s.createDataFrame([("a", "2024-01-30 23:59:00", "2024-01-30 23:59:50", 5)], "call_id string, started_at string, ts string, output_tokens long").selectExpr("call_id", "cast(started_at as timestamp_ntz) as started_at", "cast(ts as timestamp_ntz) as ts", "output_tokens"), usage_events(s, d), AS_OF)
)


def _stored_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted values of the days written in two halves, one day of them again, and the summary of 30 of them without the rows."""
    x, folder = usage_events(spark, sf_dir), scratch(spark, "values")
    for days in ("ts < timestamp'2024-01-15'", "ts >= timestamp'2024-01-15'", "to_date(ts) = date'2024-01-05'"):
        sinks.write_day_values(x.filter(days), folder)
    return performance.of_values(sinks.load_day_values(spark, folder, "2024-01-02", "2024-01-30"))


MEDIANS = ", ".join(f"median({c}) as median_{c}" for c in performance.METRICS)
query("stored_medians", f"select provider, model, count(*) as calls, count(*) filter (where status = 'failed') as failed, {MEDIANS} from x where ts >= date '2024-01-02' and ts < date '2024-01-31' group by 1, 2")(_stored_medians)


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of sessions: every seventh lags from the 20th on, and one of a collector has not been begun."""
    x = usage_events(spark, sf_dir).selectExpr("source as collector", "concat(source, '/', session_id) as path", "ts", "cast(substring(session_id, 2) as int) % 7 = 0 as lags", "session_id = 's3' as unread")
    files = x.select("collector", "path", "lags", "unread").distinct().selectExpr("collector", "path", "if(unread, 0, if(lags, 5, 9)) as consumed", "9 as size")
    return retention.frontier(files, x.filter("not unread and (not lags or ts < timestamp'2024-01-20')").select("path", "ts"))


query("frontier", """with f as (select source as collector, session_id, max(case when cast(substring(session_id, 2) as int) % 7 <> 0 or ts < timestamp '2024-01-20' then ts end) as last from x group by 1, 2)
select collector, case when bool_or(session_id = 's3' or (cast(substring(session_id, 2) as int) % 7 = 0 and last is null)) then null when bool_or(cast(substring(session_id, 2) as int) % 7 = 0) then min(case when cast(substring(session_id, 2) as int) % 7 = 0 then last end) else max(last) end as complete_through from f group by 1""")(_frontier)
