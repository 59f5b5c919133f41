"""Queries over what collectors leave: log lines, database rows, snapshots and captured exchanges, written from `events` and read
back by the sources and parsers. Their oracle SQL is over the original events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import exchange, limits, reconcile, status, usage
from ..operators.ordered import carried
from ..scratch import scratch
from ..sources import collect, lines, parse
from ..sources.adapter import AS_OF, usage_events
from .registry import query

US = F.unix_micros


def through_files(made: DataFrame) -> DataFrame:
    """Lines (value) written to files and read back with their offsets by the line source."""
    spark = made.sparkSession
    folder = scratch(spark, "logs")
    made.repartition("value").write.text(folder)
    lines.register(spark)
    return spark.read.format("offset_lines").option("path", folder).option("glob", "*.txt").option("range_bytes", str(1 << 20)).load()


def stamp(ts: str) -> str:
    return f"concat(date_format({ts}, 'yyyy-MM-dd'), 'T', date_format({ts}, 'HH:mm:ss.SSSSSS'), 'Z')"


# Assistant transcripts: each call with a zero-token line before it, lines of a wrong type and synthetic ones --------------------


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = usage_events(spark, sf_dir).filter("source = 'transcript'")
    usage_ = "named_struct('input_tokens', input_tokens, 'output_tokens', {out}, 'cache_read_input_tokens', cache_read, 'cache_creation_input_tokens', cache_create)"
    line = "to_json(named_struct('type', 'assistant', 'sessionId', session_id, 'timestamp', " + stamp("ts") + ", 'cwd', concat('/home/u/', project), 'requestId', concat('r', arrival_seq), 'message', named_struct('id', dedup_key, 'model', if(provider = 'claudeCode', concat('Claude-', model), model), 'usage', {usage})))"
    whole, part = (line.format(usage=usage_.format(out=out)) for out in ("output_tokens", "0"))
    broken = f"replace({whole}, '\"input_tokens\":', '\"input_tokens\":\"x\",\"y\":')"
    synthetic = f"replace({whole}, if(provider = 'claudeCode', concat('Claude-', model), model), '<synthetic>')"
    each = f"array({whole}, {part}, if(arrival_seq % 7 = 0, {broken}, null), if(arrival_seq % 11 = 0, {synthetic}, null), if(arrival_seq % 13 = 0, '{{\"type\":\"assistant\"', null))"
    return x.selectExpr(f"explode({each}) as value").filter("value is not null")


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collect.as_usage_events(parse.transcripts(through_files(transcript_lines(spark, sf_dir))))
    return reconcile.strongest_per_key(found).select("dedup_key", US("ts").alias("ts_us"), "provider", "source", "model", "session_id", "project", "input_tokens", "output_tokens", "cache_read", "cache_create", "token_accuracy")


query("collect_transcripts", "select dedup_key || ':r' || arrival_seq as dedup_key, epoch_us(ts) as ts_us, provider, source, case when provider = 'claudeCode' then 'Claude-' || model else model end as model, session_id, project, input_tokens, output_tokens, cache_read, cache_create, token_accuracy from x where source = 'transcript'")(_transcripts)

# Session files: model and session are named by lines before ---------------------------------------------------------------------

#: SQL that both engines share.
MARKS = ["case when arrival_seq % 3 = 0 then model when arrival_seq % 5 = 0 then '' end as named", "case when arrival_seq % 4 = 0 then concat('S', arrival_seq % 8) end as meta", "case when arrival_seq % 6 = 0 then 0 else input_tokens end as i", "case when arrival_seq % 6 = 0 then 0 else output_tokens end as o"]


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = usage_events(spark, sf_dir).filter("source = 'codexTranscript'").selectExpr("*", *MARKS)
    meta = "if(meta is not null, to_json(named_struct('type', 'session_meta', 'payload', named_struct('id', meta, 'cwd', concat('/w/', meta, '-p/')))), null)"
    turn = "if(named is not null, to_json(named_struct('type', 'turn_context', 'payload', named_struct('model', named))), null)"
    call = "to_json(named_struct('type', 'event_msg', 'timestamp', " + stamp("ts") + ", 'payload', named_struct('type', 'token_count', 'info', named_struct('last_token_usage', named_struct('input_tokens', i, 'cached_input_tokens', cache_read, 'output_tokens', o, 'reasoning_output_tokens', reasoning)), 'rate_limits', named_struct('primary', named_struct('used_percent', cast(arrival_seq % 101 as double), 'window_minutes', 300, 'resets_at', 1.7e9D)))))"
    return x.selectExpr("concat('/logs/', session_id, '.jsonl') as path", "arrival_seq", f"posexplode(array({meta}, {turn}, {call})) as (k, line)").filter("line is not null").selectExpr("path", "arrival_seq * 10 + k as byte_offset", "line", "cast(null as timestamp) as mtime")


CARRIED = f"with c as (select *, {', '.join(MARKS)} from x where source = 'codexTranscript'), l as (select *, coalesce(last_value(nullif(named, '') ignore nulls) over w, 'Codex') as carried, last_value(meta ignore nulls) over w as known from c window w as (partition by session_id order by arrival_seq rows between unbounded preceding and current row))"
query("collect_sessions", f"{CARRIED} select 'codex:/logs/' || session_id || '.jsonl:' || (arrival_seq * 10 + 2) as dedup_key, epoch_us(ts) as ts_us, carried as model, coalesce(known, session_id) as session_id, known || '-p' as project, i as input_tokens, o as output_tokens, cache_read, reasoning from l where i > 0 or o > 0")(
    lambda s, d: parse.codex_sessions(session_lines(s, d)).select("dedup_key", US("ts").alias("ts_us"), "model", "session_id", "project", "input_tokens", "output_tokens", "cache_read", "reasoning")
)
query("collect_quota", "select epoch_us(ts) as ts_us, arrival_seq * 10 + 2 as arrival_seq, 'primary' as \"window\", cast(arrival_seq % 101 as double) as percent, cast(300 as bigint) as minutes, 1700000000000000 as resets_us from x where source = 'codexTranscript'")(
    lambda s, d: parse.codex_quota(session_lines(s, d)).select(US("ts").alias("ts_us"), "arrival_seq", "window", "percent", "minutes", US("resets_at").alias("resets_us"))
)


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = usage_events(spark, sf_dir).selectExpr("session_id as path", "arrival_seq as offset", "case when arrival_seq % 5 = 0 then '' when arrival_seq % 3 = 0 then model end as named")
    last = carried(found, ["path"], F.floor(F.col("offset") / 1000), ["offset"], F.when(F.col("named") != "", F.col("named")), "model")
    return last.select("path", "offset", F.coalesce("model", F.lit("Codex")).alias("model"))


query("carry_forward_model", "with l as (select session_id as path, arrival_seq as \"offset\", case when arrival_seq % 5 = 0 then '' when arrival_seq % 3 = 0 then model end as named from x) select path, \"offset\", coalesce(last_value(nullif(named, '') ignore nulls) over (partition by path order by \"offset\" rows between unbounded preceding and current row), 'Codex') as model from l")(_carried)

# Prediction logs: counts as numbers or text, seconds or milliseconds, other keys -------------------------------------------------


def studio_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = usage_events(spark, sf_dir).filter("source = 'lmStudioLog'")
    line = """concat('{"timestamp":', case when arrival_seq % 3 = 0 then cast(unix_micros(cast(ts as timestamp)) div 1000 as string) when arrival_seq % 3 = 1 then concat('"', """ + stamp("ts") + """, '"') else cast(unix_micros(cast(ts as timestamp)) div 1000000 as string) end,
      ',"data":{"type":"llm.prediction.output","predictionId":"', dedup_key, '",', if(arrival_seq % 4 = 0, '"modelPath":"', '"modelIdentifier":"'), model, '","output":"said","stats":{"promptTokensCount":', if(arrival_seq % 2 = 0, concat('"', input_tokens, '"'), cast(input_tokens as string)),
      ',"predictedTokensCount":', output_tokens, if(tps is null, '', concat(',"', if(arrival_seq % 2 = 0, 'tokensPerSecond', 'tokens_per_second'), '":', tps)), ',"stopReason":"eos"}}}')"""
    none = """'{"data":{"type":"llm.prediction.output","predictionId":"none","stats":{"promptTokensCount":0,"predictedTokensCount":"0"}}}'"""
    asked = """'{"data":{"type":"llm.prediction.input","about":"llm.prediction.output","stats":{"promptTokensCount":7}}}'"""
    return x.selectExpr(f"explode(array({line}, if(arrival_seq % 9 = 0, {none}, null), if(arrival_seq % 8 = 0, {asked}, null))) as value").filter("value is not null")


query("collect_studio", "select 'lmstudio:' || dedup_key as dedup_key, case when arrival_seq % 3 < 2 then epoch_us(ts) // 1000 else epoch_us(ts) // 1000000 * 1000 end as ts_ms, model, 'lmstudio:' || model as session_id, input_tokens, output_tokens, tps, 'eos' as finish_reason from x where source = 'lmStudioLog' and (input_tokens > 0 or output_tokens > 0)")(
    lambda s, d: parse.lmstudio(through_files(studio_lines(s, d))).select("dedup_key", F.expr("unix_micros(ts) div 1000").alias("ts_ms"), "model", "session_id", "input_tokens", "output_tokens", "tps", "finish_reason")
)

# Desktop database rows ---------------------------------------------------------------------------------------------------------

MESSAGES = ["arrival_seq as id", "concat('c', session_id) as chat_id", "case when arrival_seq % 5 = 0 then null else model end as model_name", "case when arrival_seq % 4 = 0 then 'user' else 'assistant' end as role"]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = usage_events(spark, sf_dir)
    return x.selectExpr(*MESSAGES, "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') as created_at", "date_format(ts + make_dt_interval(0, 0, 0, arrival_seq % 20 - 5), 'yyyy-MM-dd HH:mm:ss.SSSSSS') as updated_at", "cast(arrival_seq % 6 = 0 as int) as stream")


query("collect_desktop", f"with m as (select {', '.join(MESSAGES)}, ts, arrival_seq from x where arrival_seq % 6 <> 0) select 'ollama-desktop:' || id as dedup_key, epoch_us(ts + (arrival_seq % 20 - 5) * interval 1 second) as ts_us, coalesce(model_name, '') as model, 'ollama-app:' || chat_id as session_id, greatest(cast(arrival_seq % 20 - 5 as double), 0.0) as duration_s, 'unknown' as token_accuracy, cast(0 as bigint) as input_tokens from m where role = 'assistant'")(
    lambda s, d: parse.desktop_rows(messages(s, d)).select("dedup_key", US("ts").alias("ts_us"), "model", "session_id", "duration_s", "token_accuracy", "input_tokens")
)


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second look: every tenth row was streaming at the first look and is done now or gone; the last rows are new."""
    from ..sources.sqlite import increment

    m = messages(spark, sf_dir).filter("not (id % 10 = 0 and id % 30 = 0)")
    first = messages(spark, sf_dir)
    seen = first.agg(F.max("id")).first()[0] // 2
    pending = first.filter(f"role = 'assistant' and id % 10 = 0 and id <= {seen}").selectExpr("id", "cast(id % 20 = 0 as int) as misses")
    done, open_ = increment(m, seen, pending)
    return done.selectExpr("id", "'emitted' as state", "0 as misses").unionByName(open_.selectExpr("id", "'pending' as state", "misses"))


query("desktop_pending", f"""with f as (select {', '.join(MESSAGES)}, case when arrival_seq % 6 = 0 then 1 else 0 end as stream from x), e as (select max(id) // 2 as seen from f), o as (select f.* from f where role = 'assistant' and not (id % 10 = 0 and id % 30 = 0)),
p as (select id, case when id % 20 = 0 then 1 else 0 end as misses from f, e where role = 'assistant' and id % 10 = 0 and id <= seen),
d as (select o.id from o, e where stream = 0 and (id > seen or id in (select id from p))),
q as (select p.id, case when o.id is null then p.misses + 1 else 0 end as misses from p left join o on o.id = p.id union all select o.id, 0 from o, e where id > seen and stream <> 0)
select id, 'emitted' as state, 0 as misses from d union all select id, 'pending', misses from q where id not in (select id from d) and misses < 2""")(_pending)

# Session names ------------------------------------------------------------------------------------------------------------------


def name_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = usage_events(spark, sf_dir)
    said = "case arrival_seq % 4 when 0 then '<command>' when 1 then 'Caveat: none' when 2 then concat(' asks\\n', repeat('word ', 20), arrival_seq) else '' end"
    user = f"to_json(named_struct('type', 'user', 'sessionId', session_id, 'isMeta', arrival_seq % 10 = 2, 'message', named_struct('content', {said})))"
    title = "if(arrival_seq % 40 = 0 and user_no % 3 = 0, to_json(named_struct('type', 'ai-title', 'sessionId', session_id, 'aiTitle', concat('Title ', arrival_seq))), null)"
    rows = x.selectExpr("*", "cast(substring(session_id, 2) as int) as user_no").selectExpr("session_id", "arrival_seq", f"posexplode(array({user}, {title})) as (k, line)")
    return rows.filter("line is not null").selectExpr("concat('/logs/', session_id, '.jsonl') as path", "arrival_seq * 10 + k as byte_offset", "line", "timestamp'2024-01-01' as mtime")


query("session_names", """with u as (select *, cast(substring(session_id, 2) as int) as user_no from x), t as (select session_id, arg_max('Title ' || arrival_seq, arrival_seq) as told from u where arrival_seq % 40 = 0 and user_no % 3 = 0 group by 1),
s as (select session_id, arg_min(arrival_seq, arrival_seq) as a from u where arrival_seq % 4 = 2 and arrival_seq % 10 <> 2 group by 1), f as (select session_id, 'asks ' || repeat('word ', 20) || a as flat from s)
select coalesce(t.session_id, f.session_id) as session, coalesce(told, substring(flat, 1, 60) || '…') as name from t full join f on t.session_id = f.session_id""")(lambda s, d: parse.session_names(name_lines(s, d)))

# Snapshots ----------------------------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded models of each user as JSON: an object with models, an array, or nothing where the poll failed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id % 5 as m", "event_id % 3 as v").distinct()
    one = "if(user_id % 2 = 0, to_json(named_struct('name', concat('m', m), 'size', m * 100 + v, 'size_vram', v)), to_json(named_struct('identifier', concat('m', m), 'sizeBytes', m * 100 + v)))"
    each = e.selectExpr("user_id", f"{one} as item").groupBy("user_id").agg(F.array_join(F.collect_list("item"), ",").alias("items"))
    return each.selectExpr("concat('u', user_id) as provider", "case when user_id % 7 = 0 then null when user_id % 2 = 0 then concat('{\"models\":[', items, ']}') else concat('[', items, ']') end as json")


MODELS = "i as (select distinct user_id, event_id % 5 as m, event_id % 3 as v from events where user_id % 7 <> 0)"
query("loaded_models", f"with {MODELS} select 'u' || user_id as provider, 'm' || m as model, m * 100 + v as size, case when user_id % 2 = 0 then v else -1 end as vram from i")(lambda s, d: parse.loaded_models(_snapshots(s, d)).select("provider", "model", "size", F.coalesce("vram", F.lit(-1)).cast("long").alias("vram")))
query("model_fingerprint", f"with {MODELS}, t as (select user_id, 'm' || m || '@' || (m * 100 + v) || '@' || case when user_id % 2 = 0 then cast(v as varchar) else '' end as one from i) select 'u' || user_id as provider, string_agg(one, '|' order by one) as fingerprint from t group by 1")(lambda s, d: parse.model_fingerprint(parse.loaded_models(_snapshots(s, d))))


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse.loaded_models(_snapshots(spark, sf_dir)).select("provider", "model", "size")
    polled = found.filter("provider in ('u1', 'u2', 'u3')").withColumn("size", F.lit(7).cast("long")).filter("provider <> 'u3' and model <> 'm1'")
    return collect.replace_models(found, polled, ["u1", "u2", "u3"])


query("model_snapshot", f"with {MODELS} select 'u' || user_id as provider, 'm' || m as model, m * 100 + v as size from i where user_id not in (1, 2, 3) union all select 'u' || user_id, 'm' || m, 7 from i where user_id in (1, 2) and m <> 1")(_replaced)


def _account_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return u.selectExpr("concat('a', user_id) as account", "concat('{\"five_hour\":', if(user_id % 3 = 0, '{}', concat('{\"utilization\":', user_id % 101, ',\"resets_at\":\"2024-01-02T03:04:05Z\"}')), if(user_id % 4 = 0, '', concat(',\"seven_day\":{\"utilization\":', user_id % 50, '}')), '}') as json")


query("account_windows", "with u as (select distinct user_id from events) select 'a' || user_id as account, 'session' as \"window\", case when user_id % 3 = 0 then 0.0 else cast(user_id % 101 as double) end as utilization, case when user_id % 3 = 0 then null else 1704164645.0 end as resets_at, 300 as minutes from u union all select 'a' || user_id, 'weekly', cast(user_id % 50 as double), null, 10080 from u where user_id % 4 <> 0")(lambda s, d: limits.account_windows(_account_json(s, d)))


def _quota_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at depths up to nine, out of range ones, and repeated ones."""
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    deep = "concat(repeat('{\"x\":[', cast(user_id % 5 as int)), '{\"used_percent\":', user_id % 101, ',\"window_minutes\":300}', repeat(']}', cast(user_id % 5 as int)))"
    return u.selectExpr("concat('a', user_id) as account", f"concat('{{\"d\":', {deep}, ',\"e\":{{\"utilization\":\"', user_id % 90, '\",\"limit_window_seconds\":', if(user_id % 2 = 0, 604800, 60), '}},\"f\":{{\"used_percent\":140}},\"g\":', {deep}, ',\"h\":{{\"used_percent\":1}}}}') as json")


query("quota_walk", "with u as (select distinct user_id from events), w as (select 'a' || user_id as account, cast(user_id % 101 as double) as percent, cast(300 as bigint) as minutes from u union all select 'a' || user_id, cast(user_id % 90 as double), case when user_id % 2 = 0 then 10080 else 1 end from u), r as (select *, row_number() over (partition by account order by minutes) as n from w) select account, percent, minutes, case when n = 1 then 'primary' else 'secondary' end as \"window\" from r where n <= 2")(lambda s, d: limits.quota_walk(_quota_json(s, d)).select("account", "percent", "minutes", "window"))


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    incident = "named_struct('id', cast(i as string), 'name', concat('incident ', i), 'status', if(i % 3 = 0, 'resolved', 'open'), 'incident_updates', if(i % 2 = 0, array(named_struct('body', concat('update ', i)), named_struct('body', 'older')), array()))"
    part = "named_struct('id', cast(i as string), 'name', concat('part ', i), 'status', if(i % 2 = 0, 'degraded', 'operational'), 'group', i = 4)"
    doc = f"to_json(named_struct('status', named_struct('indicator', 'major'), 'components', transform(sequence(0, user_id % 11), i -> {part}), 'incidents', transform(sequence(0, user_id % 6), i -> {incident})))"
    return u.selectExpr("concat('svc', user_id) as service", f"{doc} as json")


query("status_shown", """with u as (select distinct user_id from events), i as (select user_id, list_filter(range(0, user_id % 6 + 1), lambda i: i % 3 <> 0)[1:2] as l, list_filter(range(0, user_id % 11 + 1), lambda i: i % 2 = 0 and i <> 4)[1:3] as c from u)
select 'svc' || user_id as service, 'major' as effective, array_to_string(list_transform(l, lambda i: 'incident ' || i || case when i % 2 = 0 then ': update ' || i else '' end), '|') as news, array_to_string(list_transform(c, lambda i: 'part ' || i), '|') as affected from i""")(lambda s, d: status.shown(status.parse(_feeds(s, d))).select("service", "effective", F.array_join("news", "|").alias("news"), F.array_join("affected", "|").alias("affected")))

# Times as sources write them ----------------------------------------------------------------------------------------------------


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.format import epoch_or_iso

    e = usage_events(spark, sf_dir)
    text = "case arrival_seq % 5 when 0 then cast(unix_micros(cast(ts as timestamp)) div 1000000 as string) when 1 then cast(unix_micros(cast(ts as timestamp)) div 1000 as string) when 2 then " + stamp("ts") + " when 3 then concat(date_format(ts, 'yyyy-MM-dd'), 'T', date_format(ts, 'HH:mm:ss'), 'Z') else 'soon' end"
    return e.selectExpr("arrival_seq", f"{text} as text").select("arrival_seq", *[F.coalesce(F.floor(epoch_or_iso(F.col("text"), least) * 1000 + 0.5), F.lit(-1)).cast("long").alias(n) for n, least in (("ms", 0.0), ("ms_over", 1e9))])


MS = "case arrival_seq % 5 when 0 then epoch_us(ts) // 1000000 * 1000 when 1 then epoch_us(ts) // 1000 when 2 then (epoch_us(ts) + 500) // 1000 when 3 then epoch_us(ts) // 1000000 * 1000 else -1 end"
query("source_times", f"select arrival_seq, {MS} as ms, {MS} as ms_over from x")(_times)

# Captured exchanges: one connection for each user, requests and responses in pieces of 37 bytes --------------------------------


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exchange rows of Ollama's calls: native streams in chunks, events with a length, embeddings, failures and cut-off answers."""
    x = usage_events(spark, sf_dir).filter("provider = 'ollama'").selectExpr("*", "arrival_seq % 5 as kind", "row_number() over (partition by session_id order by arrival_seq) as n")
    path = "element_at(array('/api/chat?v=1', '/v1/responses', '/api/embed', '/api/chat', '/v1/messages'), cast(kind as int) + 1)"
    body = "to_json(named_struct('model', concat(model, if(arrival_seq % 2 = 0, ':cloud', '')), 'stream', kind = 0))"
    ask = f"concat('POST ', {path}, ' HTTP/1.1\\r\\nContent-Length: ', octet_length({body}), '\\r\\nX-Request-Id: rq', arrival_seq, '\\r\\n\\r\\n', {body})"
    native = "concat(repeat('{\"model\":\"q\",\"done\":false}\\n', cast(arrival_seq % 4 as int)), '{\"done\":true,\"done_reason\":\"stop\",\"prompt_eval_count\":', input_tokens, ',\"eval_count\":', output_tokens, ',\"eval_duration\":2000000000}\\n')"
    sse = "concat('event: x\\ndata: {\"type\":\"response.output_text.delta\"}\\n\\ndata: {\"type\":\"response.completed\",\"response\":{\"id\":\"resp', arrival_seq, '\",\"usage\":{\"input_tokens\":', input_tokens, ',\"output_tokens\":', output_tokens, ',\"output_tokens_details\":{\"reasoning_tokens\":3}}}}\\n\\n')"
    embed = "concat('{\"embeddings\":[[1]],\"prompt_eval_count\":', input_tokens, '}')"
    whole = "concat('{\"type\":\"message\",\"model\":\"c\",\"error\":null,\"stop_reason\":\"end\",\"usage\":{\"input_tokens\":', input_tokens, ',\"output_tokens\":', output_tokens, '}}')"
    sized = lambda text, code="200": f"concat('HTTP/1.1 {code} X\\r\\nContent-Length: ', octet_length({text}), '\\r\\n\\r\\n', {text})"
    half = "cast(octet_length(body) div 2 as int)"
    in_chunks = f"concat('HTTP/1.1 100 Continue\\r\\n\\r\\nHTTP/1.1 200 OK\\r\\nTransfer-Encoding: chunked\\r\\n\\r\\n', lower(hex({half})), '\\r\\n', left(body, {half}), '\\r\\n', lower(hex(octet_length(body) - {half})), ';x=1\\r\\n', substring(body, {half} + 1), '\\r\\n0\\r\\nT: 1\\r\\n\\r\\n')"
    told = x.selectExpr("*", f"{ask} as ask", f"case kind when 0 then {native} when 1 then {sse} when 2 then {embed} when 3 then '{{\"error\":\"no\"}}' else {whole} end as body")
    sent = told.selectExpr("session_id", "n", "ask", f"case kind when 0 then {in_chunks} when 3 then {sized('body', '500')} else {sized('body')} end as answer")
    sides = sent.selectExpr("session_id as conn_id", "n", "stack(2, 'request', ask, 'response', answer) as (direction, text)")
    pieces = sides.selectExpr("conn_id", "direction", "n", "posexplode(transform(sequence(0, (octet_length(text) - 1) div 37), i -> substring(text, cast(i * 37 + 1 as int), 37))) as (k, piece)")
    last = F.max(F.struct("n", "k")).over(W.partitionBy("conn_id", "direction"))
    return pieces.withColumn("last", last).selectExpr("conn_id", "n * 100000 + k as seq", "direction", "cast(piece as binary) as bytes", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, n * 10 + if(direction = 'response', 2, 0)) as ts", "n = last.n and k = last.k as closed")


CALLS = """with c as (select *, arrival_seq % 5 as kind, row_number() over (partition by session_id order by arrival_seq) - 1 as n from x where provider = 'ollama')
select session_id as conn_id, n, list_extract(['/api/chat', '/v1/responses', '/api/embed', '/api/chat', '/v1/messages'], cast(kind as int) + 1) as path, list_extract(['chat', 'responses', 'embedding', 'chat', 'chat'], cast(kind as int) + 1) as operation, case when arrival_seq % 2 = 0 then 'cloud' else 'local' end as location,
case when kind = 3 then 0 else input_tokens end as input, case when kind in (2, 3) then 0 else output_tokens end as output, case when kind = 1 then 3 else 0 end as reasoning, case kind when 0 then arrival_seq % 4 when 1 then 1 else 0 end as approx_output,
case when kind = 3 then 'failed' else 'succeeded' end as status, case when kind = 3 then 500 else 200 end as http_status, case when kind = 3 then 'http_500' end as error_category, case kind when 0 then 'stop' when 4 then 'end' end as finish_reason, case when kind = 1 then 'resp' || arrival_seq else 'rq' || arrival_seq end as request_id,
case when kind = 0 and output_tokens > 0 then output_tokens / 2.0 end as tps, case when (kind = 0 and arrival_seq % 4 > 0) or kind = 1 then 2.0 end as ttft_s, 2.0 as duration_s from c"""
query("exchange_calls", CALLS)(lambda s, d: exchange.calls(exchange.framed(captured(s, d))).select("conn_id", "n", "path", "operation", "location", "input", "output", "reasoning", "approx_output", "status", "http_status", "error_category", "finish_reason", "request_id", "tps", "ttft_s", "duration_s"))
query("exchange_events", f"with k as ({CALLS}) select 'proxy:' || conn_id || ':' || n as dedup_key, 'ollama-direct' as session_id, input as input_tokens, case when output > 0 then output else approx_output end as output_tokens, case when status = 'failed' then 'unknown' else 'exact' end as token_accuracy, status, path as endpoint from k where output > 0 or approx_output > 0 or input > 0 or status = 'failed'")(lambda s, d: exchange.as_events(exchange.calls(exchange.framed(captured(s, d)))).select("dedup_key", "session_id", "input_tokens", "output_tokens", "token_accuracy", "status", "endpoint"))

# All collectors together --------------------------------------------------------------------------------------------------------


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collect.silver(parse.transcripts(through_files(transcript_lines(spark, sf_dir))), parse.codex_sessions(session_lines(spark, sf_dir)), parse.lmstudio(through_files(studio_lines(spark, sf_dir))))
    return usage.totals(found, "month", AS_OF, "provider", "source")


query("collect_all", f"""{CARRIED}, s as (select provider, source, input_tokens, output_tokens, cache_read, cache_create, cast(0 as bigint) as reasoning, ts from x where source = 'transcript'
union all select 'codex', source, i, o, cache_read, 0, reasoning, ts from l where i > 0 or o > 0 union all select provider, source, input_tokens, output_tokens, 0, 0, 0, ts from x where source = 'lmStudioLog' and (input_tokens > 0 or output_tokens > 0))
select provider, source, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(cache_read) as bigint) as cache_read, cast(sum(cache_create) as bigint) as cache_create, cast(sum(reasoning) as bigint) as reasoning, count(*) as calls, cast(0 as bigint) as unmetered from s where ts >= date '2024-01-30' - interval 29 day group by 1, 2""")(_silver)
