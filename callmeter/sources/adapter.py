"""Usage events made from the driver's `events` table, with the same SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-30 23:59:59"

#: Usage events of `events`; then proxy twins of half of the Ollama transcript rows, around both matching tolerances.
SQL = """
raw_events as (select event_id, ts, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from {events}),
raw_calls as (select event_id, ts,
  case user_id % 4 when 0 then 'claudeCode' when 1 then 'codex' when 2 then 'ollama' else 'lmStudio' end as provider,
  case when user_id % 4 = 0 then 'transcript' when user_id % 4 = 1 then 'codexTranscript' when user_id % 4 = 3 then 'lmStudioLog'
       when event_id % 3 = 0 then 'transcript' when event_id % 3 = 1 then 'proxy' else 'ollamaDesktop' end as source,
  concat('m', cast(user_id % 6 as string)) as model, concat('s', cast(user_id as string)) as session_id,
  case when user_id % 5 = 0 then null else concat('proj', cast(user_id % 7 as string)) end as project,
  cast(round(value * 100) as bigint) as tokens_in, k, (event_id * 37) % 500 as cr, (event_id * 11) % 50 as cc,
  case event_type when 'error' then 'failed' when 'signup' then 'cancelled' else 'succeeded' end as status,
  case when event_type in ('view', 'purchase') then value end as tps,
  case when event_id % 9 = 0 then null else cast(event_id % 97 as double) / 4 end as duration_s,
  case when event_id % 7 = 0 then null else cast(event_id % 13 as double) / 8 end as ttft_s from raw_events),
raw_usage as (select concat('k', cast(event_id as string)) as dedup_key, ts, provider, source, model, session_id, project,
  case when source = 'ollamaDesktop' then 0 else tokens_in end as input_tokens, case when source = 'ollamaDesktop' then 0 else k end as output_tokens,
  case when source = 'ollamaDesktop' then 0 else cr end as cache_read, case when source = 'ollamaDesktop' then 0 else cc end as cache_create,
  case when provider = 'codex' then cast(floor(k / 2.0) as bigint) else cast(0 as bigint) end as reasoning,
  case when source = 'ollamaDesktop' then 'unknown' when source = 'proxy' and event_id % 5 = 0 then 'estimated' else 'exact' end as token_accuracy,
  status, tps, duration_s, ttft_s, event_id as arrival_seq from raw_calls),
raw_proxies as (select concat('t', cast(event_id as string)) as dedup_key, ts + (event_id % 200) * interval '1' second as ts, provider, 'proxy' as source, model, session_id, project,
  tokens_in as input_tokens, k + (event_id % 7) - 3 as output_tokens, cr as cache_read, cc as cache_create, cast(0 as bigint) as reasoning, 'exact' as token_accuracy,
  status, tps, duration_s, ttft_s, 1000000000 + event_id as arrival_seq from raw_calls where provider = 'ollama' and source = 'transcript' and event_id % 2 = 0),
raw_desktop as (select concat('d', cast(event_id as string)) as dedup_key, ts + (event_id % 9 - 4) * interval '1' second as ts, provider, 'ollamaDesktop' as source, case when event_id % 4 = 0 then '' else model end as model, session_id, project,
  cast(0 as bigint) as input_tokens, cast(0 as bigint) as output_tokens, cast(0 as bigint) as cache_read, cast(0 as bigint) as cache_create, cast(0 as bigint) as reasoning, 'unknown' as token_accuracy,
  status, cast(null as double) as tps, duration_s, ttft_s, 2000000000 + event_id as arrival_seq from raw_calls where provider = 'ollama' and source = 'proxy')"""


def usage_events(spark: SparkSession, sf_dir: str, twins: bool = False) -> DataFrame:
    """usage events of sf_dir/events.parquet; twins: with the proxy and desktop doubles of some calls."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = "select * from raw_usage" + (" union all select * from raw_proxies union all select * from raw_desktop" if twins else "")
    return spark.sql(f"with {SQL} select *, cast(null as timestamp_ntz) as started_at, cast(null as double) as load_s, false as shadowed from ({parts})", events=events)


def oracle_cte(twins: bool = False) -> str:
    """The same rows as a DuckDB `with` list that defines x."""
    parts = "select * from raw_usage" + (" union all select * from raw_proxies union all select * from raw_desktop" if twins else "")
    return f"{SQL.replace('{events}', 'events')}, x as ({parts})"
