"""Queries of the texts, labels, shapes and colours that stand beside numbers."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import format as fmt
from ..functions import shapes, texts
from ..operators import limits, performance, status, usage
from ..schema import PROVIDERS
from ..sources.adapter import AS_OF, usage_events
from .registry import query


def compact(n: str) -> str:
    """SQL of compact(); // is whole division."""
    tenth, hundredth = f"(({n} + 50) // 100)", f"(({n} + 5000) // 10000)"
    return f"case when {n} < 1000 then cast({n} as varchar) when {n} < 100000 then concat(cast({tenth} // 10 as varchar), '.', cast({tenth} % 10 as varchar), 'k') when {n} < 1000000 then concat(cast(({n} + 500) // 1000 as varchar), 'k') else concat(cast({hundredth} // 100 as varchar), '.', lpad(cast({hundredth} % 100 as varchar), 2, '0'), 'M') end"


def fixed(v: str, places: int) -> str:
    n = f"cast(floor({v} * {10**places} + 0.5) as bigint)"
    return f"concat(cast({n} // {10**places} as varchar), '.', lpad(cast({n} % {10**places} as varchar), {places}, '0'))"


def named(column: str, names: dict[str, str], other: str = "null") -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {other} end"


NAME = named("provider", texts.NAMES, "provider")
N_CALLS = "case when calls = 1 then '1 call' else format('{:,}', calls) || ' calls' end"
SUMS = "cast(sum(input_tokens) as bigint) as i, cast(sum(output_tokens) as bigint) as o, cast(sum(cache_read) as bigint) as r, cast(sum(reasoning) as bigint) as g, count(*) as calls, count(*) filter (where token_accuracy = 'unknown' and input_tokens + output_tokens + cache_read + cache_create = 0) as u"
MONTH = "ts >= date '2024-01-30' - interval 29 day"

# Calls --------------------------------------------------------------------------------------------------------------------------

EXTRA = ["case arrival_seq % 3 when 0 then 'chat' when 1 then 'image' else 'unknown' end as operation", "case when arrival_seq % 2 = 0 then cast(500 as int) end as http_status", "case when arrival_seq % 4 = 0 then 'http_500' end as error_category"]
CALLS = f"c as (select *, {', '.join(EXTRA)} from x)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_events(spark, sf_dir).selectExpr("*", *EXTRA)


SPEED = f"case when tps is not null then concat(' · ', {fixed('tps', 1)}, ' t/s') when duration_s is not null then concat(' · ', {fixed('duration_s', 1)}, 's') else '' end"
DETAIL = f"case when status = 'failed' then case when http_status is not null then 'failed · ' || http_status else 'failed' end when token_accuracy = 'unknown' and input_tokens = 0 and output_tokens = 0 then concat('tokens unavailable', {SPEED}) else concat('↑ ', {compact('input_tokens')}, case when cache_read > 0 then concat(' +', {compact('cache_read')}, ' cache') else '' end, '  ↓ ', case when token_accuracy = 'estimated' then '~' else '' end, {compact('output_tokens')}, {SPEED}) end"
HELP = f"concat_ws(' · ', {NAME}, case operation when 'unknown' then 'inference' else operation end, status, case when token_accuracy = 'unknown' and input_tokens = 0 and output_tokens = 0 then 'token counts unavailable' when token_accuracy = 'unknown' then 'token accuracy unknown' else token_accuracy || ' tokens' end, case when duration_s is not null then concat({fixed('duration_s', 2)}, 's duration') end, case when ttft_s is not null then concat({fixed('ttft_s', 2)}, 's TTFT') end, case when tps is not null then concat({fixed('tps', 1)}, ' tokens/s') end, error_category)"
query("call_texts", f"with {CALLS} select dedup_key, {NAME} as name, {DETAIL} as detail, {HELP} as help from c")(lambda s, d: _calls(s, d).select("dedup_key", texts.display_name(F.col("provider")).alias("name"), texts.call_detail().alias("detail"), texts.call_help().alias("help")))

# Totals, sessions, performance --------------------------------------------------------------------------------------------------

UNMETERED = "case when u > 0 then concat(' · ', cast(u as varchar), ' unmetered') else '' end"
MODEL = f"case when u = calls then concat('no token data · ', {N_CALLS}) else concat('↑ ', {compact('i')}, '  ↓ ', {compact('o')}, '  · ', {N_CALLS}, {UNMETERED}) end"
PROVIDER = f"case when calls = 0 then '—' when u = calls then 'tokens unavailable' else concat_ws(' ', concat('↑ ', {compact('i')}), case when r > 0 then concat('+', {compact('r')}, ' cache') end, concat('↓ ', {compact('o')}), case when g > 0 then concat('· ', {compact('g')}, ' reasoning') end, case when u > 0 then concat('· ', cast(u as varchar), ' unmetered') end) end"
query("total_texts", f"with t as (select provider, model, source, {SUMS} from x where {MONTH} group by 1, 2, 3) select provider, model, source, {MODEL} as model_text, {PROVIDER} as provider_text from t")(
    lambda s, d: usage.totals(usage_events(s, d), "month", AS_OF, "provider", "model", "source").select("provider", "model", "source", texts.model_detail().alias("model_text"), texts.provider_detail().alias("provider_text"))
)
SESSION = f"concat_ws(' · ', project, case when n <= 2 then models else cast(n as varchar) || ' models' end, {N_CALLS}, case when u = calls then 'no token data' end, case when u <> calls then concat('↑ ', {compact('i')}) end, case when u <> calls and r > 0 then concat('+', {compact('r')}, ' cache') end, case when u <> calls then concat('↓ ', {compact('o')}) end, case when u <> calls and g > 0 then concat({compact('g')}, ' reasoning') end)"
query("session_texts", f"with t as (select provider, coalesce(session_id, 'activity') as session, arg_min(struct_pack(p := case when source <> 'proxy' then project end), (ts, arrival_seq)).p as project, count(distinct model) as n, string_agg(distinct model, ', ' order by model) as models, {SUMS} from x where {MONTH} and provider = 'ollama' group by 1, 2) select session, {SESSION} as detail from t")(
    lambda s, d: usage.of_provider(usage.sessions(usage_events(s, d), "month", AS_OF), "ollama").select("session", texts.session_detail().alias("detail"))
)
query("performance_texts", f"with p as (select provider, model, count(*) as calls, count(*) filter (where status = 'failed') as failed, median(tps) as tps, median(ttft_s) as ttft from x group by 1, 2), t as (select *, concat_ws(' · ', case when tps is not null then concat({fixed('tps', 1)}, ' tok/s') end, case when ttft is not null then concat({fixed('ttft', 2)}, 's TTFT') end, case when failed > 0 then concat(cast(failed as varchar), ' failed') end) as text from p) select provider, model, case when text = '' then concat(cast(calls as varchar), ' calls') else text end as text from t")(
    lambda s, d: performance.by_model(usage_events(s, d)).select("provider", "model", texts.performance_detail().alias("text"))
)
query("headline", f"select cast(sum(input_tokens + output_tokens) as bigint) as fresh, cast(sum(cache_read + cache_create) as bigint) as cached, cast(sum(input_tokens + output_tokens + cache_read + cache_create) as bigint) as headline from x where {MONTH}")(lambda s, d: usage.headline(usage_events(s, d), "month", AS_OF, True))
query("title_split", "select provider, cast(sum(input_tokens + output_tokens) as bigint) as tokens from x where ts >= date '2024-01-30' and ts < date '2024-01-31' group by 1")(lambda s, d: usage.title_split(usage_events(s, d), AS_OF))
SLOTS = "h as (select i as hour, " + ", ".join(f"cast(coalesce(sum(case when provider = '{p}' then input_tokens + output_tokens + cache_read + cache_create end), 0) as bigint) as \"{p}\"" for p in PROVIDERS) + " from range(24) r(i) left join (select * from x where ts >= date '2024-01-30' and ts < date '2024-01-31') e on hour(e.ts) = i group by 1)"
query("past_slots", f"with {SLOTS} select * from h where hour <= 14")(lambda s, d: usage.past_slots(usage.hourly(usage_events(s, d), AS_OF, True), "hour", "2024-01-30 14:30:00"))

# Models, runtimes, readings -----------------------------------------------------------------------------------------------------

RUNTIME = ["case when user_id % 3 = 0 then 'ollama' when user_id % 3 = 1 then 'lmStudio' else 'codex' end as provider", "user_id % 2 = 0 as server", "user_id % 5 < 2 as collector", "user_id % 4 = 0 as generating", "user_id % 6 as queued", "user_id % 3 * 1234567890 as vram", "user_id * 87654321 as size", "user_id % 7 * 4096 as context", "user_id % 5 as parallel", "concat(case when user_id % 2 = 0 then 'V' else '' end, '0.', user_id) as version"]
STATE = "case user_id % 5 when 0 then 'unavailable' when 1 then 'installed' when 2 then 'connecting' when 3 then 'connected' else 'degraded' end as state"


def _runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().selectExpr("user_id", *RUNTIME, STATE)


RUNTIMES = f"q as (select user_id, {', '.join(RUNTIME)}, {STATE} from (select distinct user_id from events))"
LABEL = f"coalesce(case when provider = 'ollama' then case when server and collector then 'Daemon reachable · proxy listening on 11435' when collector then 'Proxy listening · Ollama daemon unavailable' when server then 'Daemon reachable · proxy unavailable' end when provider = 'lmStudio' then case when server and collector then 'Telemetry connected · API server running' when collector then 'Telemetry connected · API server stopped' when server then 'API server running · telemetry disconnected' end end, {named('state', texts.STATES)})"
LOADED = f"concat_ws(' · ', {NAME}, case when generating then 'generating' end, case when queued > 0 then cast(queued as varchar) || ' queued' end, case when vram > 0 then concat({fixed('(vram / 1e9)', 1)}, ' GB VRAM') when size > 0 then concat({fixed('(size / 1e9)', 1)}, ' GB') end, case when context > 0 then concat({compact('context')}, ' ctx') end, case when parallel > 1 then cast(parallel as varchar) || ' parallel' end)"
query("runtime_texts", f"with {RUNTIMES} select user_id, {LOADED} as loaded, {LABEL} as health, {named('state', texts.STATE_COLOURS)} as colour, case when provider = 'lmStudio' or lower(version) like 'v%' then version else 'v' || version end as version from q")(
    lambda s, d: _runtimes(s, d).select("user_id", texts.loaded_model_detail().alias("loaded"), texts.health_label(11435).alias("health"), texts.health_colour(F.col("state")).alias("colour"), texts.version_label(F.col("provider"), F.col("version")).alias("version"))
)
READING = "select user_id, case user_id % 4 when 0 then 'session' when 1 then 'weekly' when 2 then 'primary' else 'secondary' end as \"window\", cast(event_id * 7 % 1010 as double) / 10 as utilization, cast(case when user_id % 3 = 0 then 300 else 10080 end as bigint) as minutes, event_id from events"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READING.replace('"window"', "window").replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


RGB = {c: named("sev", {k: str(v[i]) for k, v in texts.SEVERITY_RGB.items()}) for i, c in enumerate("rgb")}
query("reading_colours", f"with q as (select *, case when utilization < 60 then 'healthy' when utilization <= 85 then 'warning' else 'danger' end as sev from ({READING})) select event_id, cast(floor(utilization + 0.5) as bigint) as percent, " + ", ".join(f"cast({v} as int) as {c}" for c, v in RGB.items()) + " from q")(
    lambda s, d: _readings(s, d).select("event_id", texts.percent(F.col("utilization")).alias("percent"), texts.severity_rgb(fmt.severity(F.col("utilization"))).alias("c")).select("event_id", "percent", "c.*")
)
WINDOW = "case when minutes >= 1440 and minutes % 1440 = 0 then concat(cast(minutes // 1440 as varchar), 'd') when minutes >= 60 and minutes % 60 = 0 then concat(cast(minutes // 60 as varchar), 'h') else concat(cast(minutes as varchar), 'm') end"
query("menu_gauges", f"with q as ({READING}), f as (select * from q where \"window\" in ('session', 'primary')) select case \"window\" when 'session' then 0 else 2 end as place, case \"window\" when 'session' then 'claudeCode' else 'codex' end as provider, case \"window\" when 'session' then '5h' else {WINDOW} end as period, cast(floor(utilization + 0.5) as bigint) as percent from f union all select 9, 'tokens', '', -1")(lambda s, d: limits.menu_gauges(_readings(s, d), "session,chatgptPrimary,tokens").fillna({"period": "", "percent": -1}))
#: Readings of the chosen gauges are those above 100 percent, if there are any; else the token count stands in.
OVER = "utilization > 100.4 and user_id % 4 in (0, 1)"
query("menu_without_gauges", f"with q as ({READING}), f as (select * from q where {OVER}) select case \"window\" when 'session' then 0 else 1 end as place, 'claudeCode' as provider, case \"window\" when 'session' then '5h' else '7d' end as period, cast(floor(utilization + 0.5) as bigint) as percent from f union all select 9, 'tokens', '', -1 where not exists (select 1 from f)")(lambda s, d: limits.menu_gauges(_readings(s, d).filter(OVER), "session,weekly").fillna({"period": "", "percent": -1}))
query("web_duration", "select event_id, case when m is null then 'limit' when m >= 1440 and m % 1440 = 0 then concat(cast(m // 1440 as varchar), 'd') when m >= 60 and m % 60 = 0 then concat(cast(m // 60 as varchar), 'h') else concat(cast(m as varchar), 'm') end as label from (select event_id, case when event_id % 9 = 0 then null else event_id % 25 * 60 end as m from events)")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "case when event_id % 9 = 0 then null else event_id % 25 * 60 end as m").select("event_id", fmt.window_label(F.col("m"), zero_is_limit=False).alias("label"))
)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).selectExpr("event_id", "window", "utilization as percent", "cast(case when utilization >= 90 then 90 else 50 end as bigint) as band", "minutes")
    return limits.alert_texts(r.withColumn("label", fmt.window_label(F.col("minutes")))).select("event_id", "title", "body", "notice_id")


def _filled(i: int) -> str:
    out = "case \"window\""
    for window, parts in limits.ALERTS.items():
        text = parts[i].replace("'", "''")
        out += f" when '{window}' then replace(replace(replace('{text}', '{{label}}', {WINDOW}), '{{band}}', case when utilization >= 90 then '90' else '50' end), '{{used}}', cast(cast(floor(utilization) as bigint) as varchar))"
    return out + " end"


query("alert_texts", f"select event_id, {_filled(0)} as title, {_filled(1)} as body, {_filled(2)} as notice_id from ({READING})")(_alerts)
INDICATOR = "['none', 'minor', 'major', 'critical', 'other']"
query("status_colours", f"select event_id, list_extract(['green', 'yellow', 'orange', 'red', 'gray'], cast(event_id % 5 as int) + 1) as colour from events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"element_at(array({INDICATOR[1:-1]}), cast(event_id % 5 as int) + 1) as i").select("event_id", status.colour(F.col("i")).alias("colour"))
)

# Charts -------------------------------------------------------------------------------------------------------------------------

DAYS = "g as (select cast(date '2024-01-30' - cast(29 - i as integer) as date) as day, i from range(30) r(i)), b as (select g.day, g.i, " + ", ".join(f"cast(coalesce(sum(case when provider = '{p}' then input_tokens + output_tokens + cache_read + cache_create end), 0) as bigint) as \"{p}\"" for p in PROVIDERS) + " from g left join x on cast(x.ts as date) = g.day group by 1, 2)"
TIP = "concat(strftime(day, '%a %b %-d'), ': ', " + ", ' · ', ".join(f"concat('{name} ', {compact(chr(34) + p + chr(34))})" for p, name in texts.NAMES.items()) + ", ' (incl. cache)')"
query("slot_texts", f"with {DAYS} select day, strftime(day, '%Y-%m-%d') as key, {TIP} as tooltip, '00:00' as first_hour, case when day = date '2024-01-30' then 'today' else strftime(day, '%b %-d') end as last from b")(
    lambda s, d: usage.daily(usage_events(s, d), "month", AS_OF, True).select("day", F.date_format("day", "yyyy-MM-dd").alias("key"), texts.bar_tooltip(texts.slot_label(F.col("day"), "month"), True).alias("tooltip"), texts.edge_labels(F.col("day"), F.col("day"), AS_OF, "today")[0].alias("first_hour"), texts.edge_labels(F.col("day"), F.col("day"), AS_OF, "month")[1].alias("last"))
)
TOTAL = " + ".join(f'"{p}"' for p in PROVIDERS)


GRID = "g as (select cast(date '2024-01-28' - cast(175 - i as integer) as date) as day from range(182) r(i)), b as (select g.day, " + ", ".join(f"cast(coalesce(sum(case when provider = '{p}' then input_tokens + output_tokens + cache_read + cache_create end), 0) as bigint) as \"{p}\"" for p in PROVIDERS) + " from g left join x on cast(x.ts as date) = g.day group by 1)"
CELL = "concat(strftime(day, '%a %b %-d'), ': ', " + compact(f"({TOTAL})") + ", ' tokens (', " + ", ' · ', ".join(f"concat('{name} ', {compact(chr(34) + p + chr(34))})" for p, name in texts.NAMES.items()) + ", ') · incl. cache')"
query("grid_texts", f"with {GRID} select day, case when day > date '2024-01-30' then '' else {CELL} end as tooltip from b")(
    lambda s, d: usage.heatmap(x := usage_events(s, d), usage.day_fold(x.limit(0)), AS_OF).select("day", texts.grid_tooltip(F.col("day"), F.col("total"), F.to_date(F.lit(AS_OF)), True).alias("tooltip"))
)
query("quota_texts", f"select event_id, concat({WINDOW}, ': ', cast(cast(floor(utilization + 0.5) as bigint) as varchar), '% used', case when utilization > 90 then ', nearest limit' else '' end) as tooltip from ({READING})")(
    lambda s, d: _readings(s, d).select("event_id", texts.quota_tooltip(fmt.window_label(F.col("minutes")), F.col("utilization"), F.col("utilization") > 90).alias("tooltip"))
)


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = usage.daily(usage_events(spark, sf_dir), "month", AS_OF, True)
    total = sum((F.col(p) for p in PROVIDERS[1:]), F.col(PROVIDERS[0]))
    most = bars.agg(F.max(total).alias("most"))
    rows = bars.crossJoin(F.broadcast(most)).withColumn("i", F.datediff("day", F.lit("2024-01-01").cast("date")))  # most is one row
    x, y = shapes.spark_point(F.col("i"), F.lit(30), total, F.col("most"), 120.0, 24.0)
    share = total / F.greatest("most", F.lit(1))
    nx, ny = shapes.needle(share)
    return rows.select("day", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(shapes.gauge_angle(share), 6).alias("angle"), F.round(nx, 6).alias("nx"), F.round(ny, 6).alias("ny"))


query("chart_points", f"with {DAYS}, t as (select day, i, {TOTAL} as v, (select greatest(max({TOTAL}), 1) from b) as most from b), w as (select *, 215.0 - 250.0 * least(greatest(v / most::double, 0.0), 1.0) as angle from t) select day, round(120.0::double * i / 29, 6) as x, round(24.0::double - 24.0::double * v / most, 6) as y, round(angle, 6) as angle, round(10.0::double + cos(angle * {pi}::double / 180) * 6.5::double * 0.92::double, 6) as nx, round(4.5::double + sin(angle * {pi}::double / 180) * 6.5::double * 0.92::double, 6) as ny from w")(_shapes)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = usage.daily(usage_events(spark, sf_dir), "month", AS_OF, True).withColumn("codex", F.expr("case when day(day) % 3 = 0 then 1 else codex end"))
    total = sum((F.col(p) for p in PROVIDERS[1:]), F.col(PROVIDERS[0]))
    most = bars.agg(F.greatest(F.max(total), F.lit(1)).cast("double").alias("most"))
    rows = bars.crossJoin(F.broadcast(most))  # most is one row
    return rows.select("day", F.explode(shapes.segment_heights(F.col("most"), 42.0)).alias("s")).select("day", "s.provider", F.round("s.height", 6).alias("height"))


HEIGHTS = " union all ".join(f"select day, {i} as pos, '{p}' as provider, \"{p}\" as v from z" for i, p in enumerate(shapes.STACK))
query("segment_heights", f"with {DAYS}, z as (select * replace (case when day(day) % 3 = 0 then 1 else codex end as codex) from b), q as (select greatest(max({TOTAL}), 1)::double as most from z), v as (select * from ({HEIGHTS}) where v > 0), h as (select v.*, greatest(42.0 * v / most, 1.5) as h from v, q), e as (select *, sum(h) over (partition by day order by pos rows between unbounded preceding and unbounded following) + count(*) over (partition by day) - 1 - 42.0 as excess, row_number() over (partition by day order by h desc, pos desc) as n from h) select day, provider, round(case when excess > 0 and n = 1 then greatest(h - excess, 1.5) else h end, 6) as height from e")(_segments)

COLOURS = ["D97757", "10A37F", "5B8DEF", "8E5CF7"]


def _blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = usage.daily(usage_events(spark, sf_dir), "month", AS_OF, True)
    mixed = shapes.with_srgb(shapes.with_blend(bars, list(PROVIDERS), COLOURS))
    return mixed.select("day", *[F.round(c, 6).alias(c) for c in ("light", "a", "b")], *[F.round(c, 4).alias(c) for c in ("red", "green", "blue")])


def _lab(colour: str) -> tuple[float, float, float]:
    """L, a, b of RRGGBB for the oracle, by the published formula in plain floats."""
    linear = lambda c: c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4
    rgb = [linear(int(colour[i : i + 2], 16) / 255) for i in (0, 2, 4)]
    lms = [sum(m * c for m, c in zip(row, rgb, strict=True)) ** (1 / 3) for row in fmt._TO_LMS]
    return tuple(sum(m * c for m, c in zip(row, lms, strict=True)) for row in fmt._TO_LAB)


def _mean(values: list[float]) -> str:
    return "(" + " + ".join(f'"{p}" * ({v!r}::double)' for p, v in zip(PROVIDERS, values, strict=True)) + ") / total"


LABS = [_lab(c) for c in COLOURS]
_LMS = [f"(light + {r[1]!r}::double * a + {r[2]!r}::double * b) ^ 3" for r in shapes._TO_LMS]
_GAMMA = "round(case when {c} <= 0.0031308 then 12.92::double * {c} else 1.055::double * pow({c}, 1 / 2.4::double) - 0.055::double end, 4)"
query("colour_blend", f"with {DAYS}, t as (select *, ({TOTAL})::double as total from b), m as (select day, total, {_mean([v[0] for v in LABS])} as light, {_mean([v[1] for v in LABS])} as a, {_mean([v[2] for v in LABS])} as b, {_mean([(v[1] ** 2 + v[2] ** 2) ** 0.5 for v in LABS])} as target from t), k as (select day, total, light, a * f as a, b * f as b from (select *, case when sqrt(a * a + b * b) > 1e-4 then least(target / sqrt(a * a + b * b), 1.6::double) else 1.0::double end as f from m)), "
      f"s as (select *, {_LMS[0]} as ll, {_LMS[1]} as mm, {_LMS[2]} as ss from k), v as (select *, " + ", ".join(f"least(greatest({r[0]!r}::double * ll + {r[1]!r}::double * mm + {r[2]!r}::double * ss, 0.0), 1.0) as {c}" for r, c in zip(shapes._TO_RGB, ("r0", "g0", "b0"), strict=True)) + f" from s) select day, " + ", ".join(f"case when total > 0 then round({c}, 6) end as {c}" for c in ("light", "a", "b")) + ", " + ", ".join(f"case when total > 0 then {_GAMMA.format(c=c)} end as {n}" for c, n in (("r0", "red"), ("g0", "green"), ("b0", "blue"))) + " from v")(_blends)  # fmt: skip
query("hex_colours", "select event_id, upper(lpad(to_hex(event_id * 7919 % 16777216), 6, '0')) as hex from events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.lpad(F.hex(F.expr("event_id * 7919 % 16777216")), 6, "0").alias("h")).select("event_id", shapes.rgb_hex([fmt.hex_rgb(F.col("h"))[c] for c in "rgb"]).alias("hex"))
)
