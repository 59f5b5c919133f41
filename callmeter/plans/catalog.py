"""Names of the queries, their programs, and the same results as DuckDB SQL."""

from __future__ import annotations

__all__ = ["ORACLES", "QUERIES"]

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..operators import limits, performance, reconcile, status, usage
from ..schema import PROVIDERS
from ..sources.adapter import AS_OF, usage_events
from .registry import ORACLES, QUERIES, query

DAY0 = "date '2024-01-30'"
SUMS = "cast(coalesce(sum(input_tokens),0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens),0) as bigint) as output_tokens, cast(coalesce(sum(cache_read),0) as bigint) as cache_read, cast(coalesce(sum(cache_create),0) as bigint) as cache_create, cast(coalesce(sum(reasoning),0) as bigint) as reasoning, count(*) as calls, count(*) filter (where token_accuracy = 'unknown' and input_tokens + output_tokens + cache_read + cache_create = 0) as unmetered"
MONTH, WEEK, TODAY = f"ts >= {DAY0} - interval 29 day", f"ts >= {DAY0} - interval 6 day", f"ts >= {DAY0} and ts < {DAY0} + interval 1 day"
CHART = "input_tokens + output_tokens + cache_read + cache_create"


def _sums(tokens: str) -> str:
    return ", ".join(f"cast(coalesce(sum({tokens}) filter (where provider = '{p}'), 0) as bigint) as \"{p}\"" for p in PROVIDERS)


def _slots(key: str, calendar: str, sums: str) -> str:
    return f"select c.{key}, " + ", ".join(f'coalesce("{p}", 0) as "{p}"' for p in PROVIDERS) + f" from ({calendar}) c left join ({sums}) s on s.{key} = c.{key}"


def _daily(days: int, tokens: str, where: str = "true") -> str:
    calendar = f"select cast({DAY0} - cast({days - 1} - i as integer) as date) as day from range({days}) r(i)"
    sums = f"select cast(ts as date) as day, {_sums(tokens)} from x where ts >= {DAY0} - interval {days - 1} day group by 1"
    return _slots("day", calendar, sums) + f" where {where}"


# Usage ------------------------------------------------------------------------------------------

query("totals_by_provider", f"select provider, {SUMS} from x where {MONTH} group by 1")(lambda s, d: usage.totals(usage_events(s, d), "month", AS_OF, "provider"))
query("totals_all", f"select {SUMS} from x where {MONTH}")(lambda s, d: usage.totals(usage_events(s, d), "month", AS_OF))
query("totals_today", f"select provider, {SUMS} from x where {TODAY} group by 1")(lambda s, d: usage.totals(usage_events(s, d), "today", AS_OF, "provider"))
query("model_totals", f"select provider, model, {SUMS} from x where {WEEK} group by 1, 2")(lambda s, d: usage.totals(usage_events(s, d), "week", AS_OF, "provider", "model"))
query("model_top5", f"with m as (select provider, model, cast(sum(input_tokens + output_tokens) as bigint) as fresh, count(*) as calls from x where {MONTH} group by 1, 2), r as (select *, cast(row_number() over (partition by provider order by fresh desc, model) as integer) as rank, count(*) over (partition by provider) as n from m) select provider, model, fresh, calls, rank, cast(greatest(n - 5, 0) as bigint) as more from r where rank <= 5")(lambda s, d: usage.top_models(usage_events(s, d), "month", AS_OF))

SESSIONS = f"select provider, coalesce(session_id, 'activity') as session, arg_min(source, (ts, arrival_seq)) as first_source, arg_min(model, (ts, arrival_seq)) as first_model, arg_min(struct_pack(p := case when source <> 'proxy' then project end), (ts, arrival_seq)).p as project, {SUMS}, max(ts) as last_activity, count(distinct model) as n_models, string_agg(distinct model, ',' order by model) as models, epoch(timestamp '{AS_OF}' - max(ts)) < 900 as is_active from x where {MONTH} group by 1, 2"
query("sessions", SESSIONS)(lambda s, d: usage.sessions(usage_events(s, d), "month", AS_OF))
query("sessions_top6", f"with s as ({SESSIONS}) select provider, session, last_activity, calls, (select count(*) from s) - 6 as more from s order by last_activity desc, provider, session limit 6")(lambda s, d: _top_sessions(s, d))


def _top_sessions(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    found = usage.sessions(usage_events(spark, sf_dir), "month", AS_OF)
    more = found.agg((F.count("*") - n).alias("more"))
    return found.orderBy(F.desc("last_activity"), "provider", "session").limit(n).select("provider", "session", "last_activity", "calls").crossJoin(F.broadcast(more))  # more is one row


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = usage_events(spark, sf_dir).select("session_id").distinct().filter("cast(substring(session_id, 2) as int) % 3 = 0")
    return ids.select(F.col("session_id").alias("session"), F.concat(F.lit("Named "), "session_id").alias("name"))


query("session_titles", f"with s as ({SESSIONS}) select provider, session, project, case when first_source = 'proxy' then 'Ollama (direct)' when first_source = 'ollamaDesktop' then 'Ollama Desktop' when cast(substring(session, 2) as int) % 3 = 0 then 'Named ' || session when provider = 'lmStudio' then 'LM Studio · ' || first_model when provider = 'codex' and project is not null then 'Codex · ' || project when provider = 'codex' then 'Codex session ' || substring(session, 1, 8) else 'Session ' || substring(session, 1, 8) end as title from s")(lambda s, d: usage.session_titles(usage.sessions(usage_events(s, d), "month", AS_OF), _names(s, d)).select("provider", "session", "project", "title"))

query("daily_week", _daily(7, CHART))(lambda s, d: usage.daily(usage_events(s, d), "week", AS_OF, True))
query("daily_month", _daily(30, CHART))(lambda s, d: usage.daily(usage_events(s, d), "month", AS_OF, True))
query("daily_month_fresh", _daily(30, "input_tokens + output_tokens"))(lambda s, d: usage.daily(usage_events(s, d), "month", AS_OF, False))
query("daily_no_weekends", _daily(30, CHART, "dayofweek(c.day) not in (0, 6)"))(lambda s, d: usage.daily(usage_events(s, d), "month", AS_OF, True, weekends=False))
HOURS = _slots("hour", "select i as hour from range(24) r(i)", f"select cast(hour(ts) as bigint) as hour, {_sums(CHART)} from x where {TODAY} group by 1")
query("hourly_today", HOURS)(lambda s, d: usage.hourly(usage_events(s, d), AS_OF, True))

FOLD = "select cast(ts as date) as day, provider, cast(sum(input_tokens) as bigint) as input, cast(sum(output_tokens) as bigint) as output, cast(sum(cache_read + cache_create) as bigint) as cache, cast(sum(reasoning) as bigint) as reasoning, count(*) as calls from x group by 1, 2"
query("day_fold", FOLD)(lambda s, d: usage.day_fold(usage_events(s, d)))


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of the 60 days before: the same days' folds, moved back."""
    return usage.day_fold(usage_events(spark, sf_dir)).withColumn("day", F.date_sub("day", 60))


query("history_merge", f"with f as ({FOLD}), g as (select * from f union all select day - 60, provider, input, output, cache, reasoning, calls from f union all select * from f where calls % 2 = 0) select cast(day as date) as day, provider, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, cast(sum(cache) as bigint) as cache, cast(sum(reasoning) as bigint) as reasoning, cast(sum(calls) as bigint) as calls from g group by 1, 2")(lambda s, d: usage.merge_history(f := usage.day_fold(usage_events(s, d)), _frozen(s, d), f.filter("calls % 2 = 0")))
GRID = f"with f as ({FOLD}), g as (select * from f union all select day - 60, provider, input, output, cache, reasoning, calls from f), q as (" + _slots("day", "select cast(date '2024-01-28' - 175 + cast(i as integer) as date) as day from range(182) r(i)", f"select cast(day as date) as day, {_sums('input + output + cache')} from g group by 1") + '), z as (select *, "claudeCode" + "codex" + "ollama" + "lmStudio" as total from q)'
query("heatmap_26w", f"{GRID} select *, case when total > 0 then round(0.32 + 0.68 * sqrt(least(1.0, total / greatest((select max(total) from z), 1)::double)), 6) else 0.0 end as opacity from z")(lambda s, d: usage.heatmap(usage_events(s, d), _frozen(s, d), AS_OF))
query("month_labels", f"{GRID}, w as (select (epoch(day::timestamp) / 86400)::bigint - 3 as n, day from z), k as (select n // 7 as week, min(day) as day from w group by 1), c as (select week - min(week) over () as \"column\", month(day) as m, day from k), b as (select *, lag(m) over (order by \"column\") as before from c), a as (select *, lead(\"column\") over (order by \"column\") as next from b where before is null or before <> m) select \"column\", strftime(day, '%b') as label from a where not (\"column\" = 0 and coalesce(next, 99) <= 2)")(lambda s, d: usage.month_labels(usage.heatmap(usage_events(s, d), _frozen(s, d), AS_OF)))

query("top_project", f"select project, cast(sum({CHART}) as bigint) as tokens from x where {MONTH} and project is not null and project <> '' group by 1 order by 2 desc, 1 limit 1")(lambda s, d: usage.top_project(usage_events(s, d), "month", AS_OF))
query("peak_slot", f'with h as ({HOURS}) select hour, "claudeCode" + "codex" + "ollama" + "lmStudio" as tokens from h order by 2 desc, 1 limit 1')(lambda s, d: usage.peak(usage.hourly(usage_events(s, d), AS_OF, True), "hour"))
query("chart_maxima", f'with h as ({HOURS}) select cast(greatest(max(greatest("claudeCode", "codex", "ollama", "lmStudio")), 1) as bigint) as grouped, cast(greatest(max("claudeCode" + "codex" + "ollama" + "lmStudio"), 1) as bigint) as stacked from h')(lambda s, d: usage.chart_maxima(usage.hourly(usage_events(s, d), AS_OF, True)))
query("latest_calls", "select dedup_key, ts, provider, model, input_tokens, output_tokens, status from x order by ts desc, arrival_seq desc limit 8")(lambda s, d: usage.latest_calls(usage_events(s, d)))
query("kernel_trend", f"""with h as ({_daily(30, CHART)}), p as (select row_number() over (order by day) - 1.0::double as i, ("claudeCode" + "codex" + "ollama" + "lmStudio")::double as v from h), n as (select count(*) as n, max(v) as top from p),
a as (select s, s / 64.0::double * (n - 1) as x, n, top from range(65) r(s), n), k as (select s, a.x, top, v, exp(-0.5 * ((a.x - i) / greatest(1.25, n / 6.0::double)) ^ 2) as w from a, p)
select s, round(x, 6) as x, round(greatest(0.0, least(greatest(top, 1.0), sum(w * v) / sum(w))), 3) as y from k group by s, x, top""")(lambda s, d: usage.kernel_trend(usage.daily(usage_events(s, d), "month", AS_OF, True), "day"))

# Reconciliation ---------------------------------------------------------------------------------


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call several times: a zero-token partial, the call, and a late weaker copy."""
    x = usage_events(spark, sf_dir)
    partial = x.withColumn("output_tokens", F.lit(0).cast("long")).withColumn("status", F.lit("running")).withColumn("arrival_seq", F.col("arrival_seq") * 3)
    late = x.filter("output_tokens % 2 = 0").withColumn("token_accuracy", F.lit("unknown")).withColumn("arrival_seq", F.col("arrival_seq") * 3 + 2)
    return partial.unionByName(x.withColumn("arrival_seq", F.col("arrival_seq") * 3 + 1)).unionByName(late)


query("strongest_per_key", """with o as (select * replace (cast(0 as bigint) as output_tokens, 'running' as status, arrival_seq * 3 as arrival_seq) from x union all select * replace (arrival_seq * 3 + 1 as arrival_seq) from x union all select * replace ('unknown' as token_accuracy, arrival_seq * 3 + 2 as arrival_seq) from x where output_tokens % 2 = 0),
r as (select *, row_number() over (partition by dedup_key order by case token_accuracy when 'exact' then 3 when 'estimated' then 2 when 'unknown' then 1 else 0 end desc, case status when 'running' then 0 when 'unknown' then 1 else 2 end desc, input_tokens + output_tokens + cache_read + cache_create desc, (duration_s is not null)::int + (ttft_s is not null)::int + (tps is not null)::int desc, arrival_seq) as n from o)
select dedup_key, token_accuracy, status, output_tokens, arrival_seq from r where n = 1""")(lambda s, d: reconcile.strongest_per_key(_observations(s, d)).select("dedup_key", "token_accuracy", "status", "output_tokens", "arrival_seq"))
PROXY = "select p.* from x p where p.source = 'proxy' and p.provider = 'ollama' and exists (select 1 from x t where t.source = 'transcript' and t.provider = 'ollama' and t.token_accuracy = 'exact' and abs(p.output_tokens - t.output_tokens) <= 2 and p.ts > t.ts - interval 120 second and p.ts < t.ts + interval 120 second)"
DESK = "select k.dedup_key from x k where k.source = 'ollamaDesktop' and k.provider = 'ollama' and exists (select 1 from x p where p.source = 'proxy' and p.provider = 'ollama' and p.dedup_key not in (select dedup_key from hp) and k.ts > p.ts - interval 4 second and k.ts < p.ts + interval 4 second and (k.model = p.model or k.model = ''))"
query("shadow_proxy", f"select dedup_key, ts, output_tokens from ({PROXY})", twins=True)(lambda s, d: reconcile.shadowed_proxies(usage_events(s, d, True)).select("dedup_key", "ts", "output_tokens"))
query("shadow_desktop", f"with hp as ({PROXY}) {DESK}", twins=True)(lambda s, d: reconcile.shadowed_desktop(reconcile.mark(e := usage_events(s, d, True), reconcile.shadowed_proxies(e))).select("dedup_key"))
query("totals_unshadowed", f"with hp as ({PROXY}), hd as ({DESK}), v as (select * from x where dedup_key not in (select dedup_key from hp) and dedup_key not in (select dedup_key from hd)) select provider, source, {SUMS} from v where {MONTH} group by 1, 2", twins=True)(lambda s, d: usage.totals(reconcile.reconcile(usage_events(s, d, True)), "month", AS_OF, "provider", "source"))

# Performance ------------------------------------------------------------------------------------

MEDIANS = "median(tps) as median_tps, median(ttft_s) as median_ttft_s, median(duration_s) as median_duration_s"
query("perf_by_provider", f"select provider, count(*) as calls, count(*) filter (where status = 'succeeded') as succeeded, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'cancelled') as cancelled, count(*) filter (where token_accuracy = 'estimated') as estimated, count(*) filter (where token_accuracy = 'unknown') as unknown_tokens, {MEDIANS} from x where provider in ('ollama', 'lmStudio') group by 1")(lambda s, d: performance.by_provider(usage_events(s, d)))
BY_MODEL = f"select provider, model, count(*) as calls, count(*) filter (where status = 'failed') as failed, {MEDIANS} from x group by 1, 2"
query("perf_by_model", BY_MODEL)(lambda s, d: performance.by_model(usage_events(s, d)))
query("perf_top5", f"{BY_MODEL} order by calls desc, lower(model), provider limit 5")(lambda s, d: performance.top_models(usage_events(s, d)))

# Ordered rules ----------------------------------------------------------------------------------


# Limits and status ------------------------------------------------------------------------------


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota readings of accounts (users), made from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("concat('a', cast(user_id as string)) as account", "case when event_id % 2 = 0 then 'primary' else 'secondary' end as window", "ts", "event_id as arrival_seq", "cast(event_id * 13 % 101 as double) as percent")


READ = "r as (select concat('a', cast(user_id as varchar)) as account, case when event_id % 2 = 0 then 'primary' else 'secondary' end as \"window\", ts, event_id as arrival_seq, cast(event_id * 13 % 101 as double) as percent from events)"
WINDOWS = "select concat(case when user_id % 2 = 0 then 'codex' else 'claude' end, case when user_id % 3 = 0 then '-primary' else '-secondary' end) as id, user_id as account, cast(max(event_id * 7 % 101) as double) as utilization, cast(max(case when user_id % 3 = 0 then 300 else 10080 end) as bigint) as minutes from {events} group by user_id"
LABEL = "case when minutes is null or minutes <= 0 then 'limit' when minutes >= 1440 and minutes % 1440 = 0 then concat(cast(minutes // 1440 as varchar), 'd') when minutes >= 60 and minutes % 60 = 0 then concat(cast(minutes // 60 as varchar), 'h') else concat(cast(minutes as varchar), 'm') end"
SEVERITY = "case when utilization < 60 then 'healthy' when utilization <= 85 then 'warning' else 'danger' end"
PLACE = "case id when 'codex-primary' then 0 when 'codex-secondary' then 1 when 'claude-primary' then 2 else 3 end"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WINDOWS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


query("limit_severity", f"with w as ({WINDOWS.format(events='events')}) select *, {LABEL} as label, {SEVERITY} as severity, least(greatest(utilization / 100, 0.0), 1.0) as fraction from w")(lambda s, d: limits.readings(_windows(s, d)))
query("limit_rail", f"with w as ({WINDOWS.format(events='events')}) select id, account, utilization, {PLACE} as place from w")(lambda s, d: limits.rail(_windows(s, d)).select("id", "account", "utilization", "place"))
query("nearest_limit", f"with w as ({WINDOWS.format(events='events')}) select id, utilization from w order by utilization desc, {PLACE}, id limit 1")(lambda s, d: limits.nearest(_windows(s, d)).select("id", "utilization"))
query("latest_quota", f"with {READ}, q as (select *, row_number() over (partition by account, \"window\" order by ts desc, arrival_seq desc) as n from r) select account, \"window\", ts, arrival_seq, percent from q where n = 1")(lambda s, d: limits.latest(_readings(s, d)))
BAND = "case when \"window\" = 'primary' then case when percent >= 90 then 90 when percent >= 75 then 75 when percent >= 50 then 50 when percent >= 25 then 25 else 0 end else case when percent >= 90 then 90 when percent >= 75 then 75 when percent >= 50 then 50 else 0 end end"
query("threshold_alerts", f"with {READ}, b as (select *, {BAND} as band from r), l as (select *, coalesce(lag(band) over (partition by account, \"window\" order by ts, arrival_seq), 0) as last from b) select account, \"window\", ts, percent, cast(band as bigint) as band, concat(account, '-', \"window\", '-', cast(band as varchar)) as alert_id from l where band > last")(lambda s, d: limits.threshold_alerts(_readings(s, d)))


def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("concat('svc', cast(user_id % 4 as string)) as service", "ts", "event_id as arrival_seq", "element_at(array('none','none','minor','major','critical'), cast(event_id % 5 as int) + 1) as indicator")


IND = "i as (select concat('svc', cast(user_id % 4 as varchar)) as service, ts, event_id as arrival_seq, list_extract(['none','none','minor','major','critical'], cast(event_id % 5 as int) + 1) as indicator from events)"
query("status_changes", f"with {IND}, l as (select *, lag(indicator) over (partition by service order by ts, arrival_seq) as before from i) select * from l where before is not null and before <> indicator")(lambda s, d: status.changes(_indicators(s, d)))
query("change_gate", f"with {IND}, l as (select *, lag(indicator) over (partition by service order by ts, arrival_seq) as before from i) select service, ts, arrival_seq, indicator from l where before is null or before <> indicator")(lambda s, d: status.significant(_indicators(s, d), "service", ["indicator"]))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status page for each user, as JSON text."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    part = lambda n: F.struct(F.format_string("c%d-" + n, "user_id").alias("id"), F.lit(n).alias("name"), F.when(F.col("user_id") % len(n) == 0, "degraded").otherwise("operational").alias("status"), (F.col("user_id") % 5 == 0).alias("group"))
    incident = F.struct(F.lit("i").alias("id"), F.lit("slow").alias("name"), F.when(F.col("user_id") % 7 == 0, "investigating").otherwise("resolved").alias("status"), F.array(F.struct(F.lit("we look").alias("body"))).alias("incident_updates"))
    doc = F.struct(F.struct(F.when(F.col("user_id") % 11 == 0, "critical").otherwise("minor").alias("indicator")).alias("status"), F.array(part("api"), part("chat"), part("login")).alias("components"), F.array(incident).alias("incidents"))
    return u.select(F.concat(F.lit("svc"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("service"), F.to_json(doc).alias("json"))


STATUS = "s as (select distinct concat('svc', lpad(cast(user_id as varchar), 6, '0')) as service, (case when user_id % 3 = 0 then 1 else 0 end + case when user_id % 4 = 0 then 1 else 0 end + case when user_id % 5 = 0 then 1 else 0 end) * case when user_id % 5 = 0 then 0 else 1 end as bad, case when user_id % 7 = 0 then 1 else 0 end as live, case when user_id % 11 = 0 then 'critical' else 'minor' end as ind from events)"
query("status_effective", f"with {STATUS} select service, case when bad + live = 0 then 'none' else ind end as effective, bad as n_components, live as n_incidents from s")(lambda s, d: status.parse(_pages(s, d)).select("service", "effective", F.size("components").alias("n_components"), F.size("incidents").alias("n_incidents")))
query("status_worst", f"with {STATUS}, ef as (select service, case when bad + live = 0 then 'none' else ind end as effective from s) select * from ef where effective <> 'none' order by case effective when 'critical' then 3 when 'major' then 2 when 'minor' then 1 else 0 end desc, service limit 1")(lambda s, d: status.worst(status.parse(_pages(s, d))))

# Labels -----------------------------------------------------------------------------------------

COMPACT = "case when n < 1000 then cast(n as varchar) when n < 100000 then concat(cast(((n + 50) // 100) // 10 as varchar), '.', cast(((n + 50) // 100) % 10 as varchar), 'k') when n < 1000000 then concat(cast((n + 500) // 1000 as varchar), 'k') else concat(cast(((n + 5000) // 10000) // 100 as varchar), '.', lpad(cast(((n + 5000) // 10000) % 100 as varchar), 2, '0'), 'M') end"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "(event_id * event_id * 37) % 3000000 as n")


query("compact_format", f"with q as (select event_id, (event_id * event_id * 37) % 3000000 as n from events) select event_id, n, {COMPACT} as label from q")(lambda s, d: _numbers(s, d).withColumn("label", fmt.compact(F.col("n"))))
UNTIL = "case when n <= 0 then 'now' when n // 3600 >= 24 then concat('in ', cast(n // 86400 as varchar), 'd ', cast((n // 3600) % 24 as varchar), 'h') when n // 3600 > 0 then concat('in ', cast(n // 3600 as varchar), 'h ', cast((n // 60) % 60 as varchar), 'm') else concat('in ', cast(n // 60 as varchar), 'm') end"
query("until_label", f"with q as (select event_id, (event_id * event_id * 37) % 3000000 - 5000 as n from events) select event_id, {UNTIL} as label from q")(lambda s, d: _numbers(s, d).select("event_id", fmt.until(F.col("n") - 5000).alias("label")))
query("duration_label", f"with q as (select event_id, event_id % 300 * case when event_id % 3 = 0 then 1440 when event_id % 3 = 1 then 60 else 1 end as minutes from events) select event_id, {LABEL} as label from q")(lambda s, d: _numbers(s, d).select("event_id", fmt.window_label(F.expr("event_id % 300 * case when event_id % 3 = 0 then 1440 when event_id % 3 = 1 then 60 else 1 end")).alias("label")))
query("request_classify", "with q as (select event_id, list_extract(['/api/chat?x=1', '/v1/responses', '/api/embed', '/other'], cast(event_id % 4 as int) + 1) as path, list_extract(['Claude-3', 'qwen:cloud', 'gpt-oss-CLOUD', 'llama'], cast(event_id // 4 % 4 as int) + 1) as model from events) select event_id, case event_id % 4 when 0 then 'chat' when 1 then 'responses' when 2 then 'embedding' else 'unknown' end as operation, case event_id // 4 % 4 when 1 then 'cloud' when 2 then 'cloud' else 'local' end as location, case event_id // 4 % 4 when 0 then 'claudeCode' else 'ollama' end as provider from q")(
    lambda s, d: _numbers(s, d).selectExpr("event_id", "element_at(array('/api/chat?x=1', '/v1/responses', '/api/embed', '/other'), cast(event_id % 4 as int) + 1) as path", "element_at(array('Claude-3', 'qwen:cloud', 'gpt-oss-CLOUD', 'llama'), cast(event_id div 4 % 4 as int) + 1) as model").select("event_id", fmt.operation_of_path(F.col("path")).alias("operation"), fmt.location_of_model(F.col("model")).alias("location"), fmt.provider_of_model(F.col("model")).alias("provider"))
)

from . import collected, described, kept, streamed  # noqa: E402, F401  (they register their queries)
