"""Parsers from lines (path, byte_offset, line, mtime) to usage observations. Text of prompts, replies and errors is never
kept: each parser projects to metadata. Markers are tested before any JSON is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.format import epoch_or_iso, provider_of_model
from ..operators.ordered import carried

#: How journal lines write times.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
#: Bytes of a file in which lines are ordered together.
BLOCK_BYTES = 64 << 20

_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
ASSISTANT = f"type string, sessionId string, timestamp string, cwd string, requestId string, message struct<id:string,model:string,usage:{_USAGE}>, _bad string"
_TOKENS = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"
_LIMIT = "struct<used_percent:double,window_minutes:int,resets_at:double>"
SESSION = f"timestamp string, type string, payload struct<type:string,id:string,cwd:string,model:string,info:struct<last_token_usage:{_TOKENS}>,rate_limits:struct<primary:{_LIMIT},secondary:{_LIMIT}>>, _bad string"


def last_part(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(last_part(path), r"\.[^.]*$", "")


def _strict(lines: DataFrame, schema: str) -> DataFrame:
    """Lines that decode without any mismatch."""
    o = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("o", o).filter("o is not null and o._bad is null").drop("line")


def _time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), F.col("mtime"))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def transcripts(lines: DataFrame) -> DataFrame:
    """Assistant calls; a message without an id is a call of its own, keyed by where it stands."""
    rows = _strict(lines.filter(F.col("line").contains('"assistant"')), ASSISTANT).filter("o.type = 'assistant' and o.message.usage is not null and o.message.model <> '<synthetic>'")
    place = F.concat_ws(":", "path", F.col("byte_offset").cast("string"))
    # concat_ws is never null, so Spark knows that no row is without a key, and does not read the lines again for such rows
    key = F.when(F.col("o.message.id").isNull(), place).otherwise(F.concat_ws(":", "o.message.id", F.coalesce("o.requestId", F.lit(""))))
    u = "o.message.usage."
    return rows.select(key.alias("dedup_key"), _time(F.col("o.timestamp")).alias("ts"), provider_of_model(F.col("o.message.model")).alias("provider"), F.lit("transcript").alias("source"), F.col("o.message.model").alias("model"), F.coalesce("o.sessionId", stem(F.col("path"))).alias("session_id"), last_part(F.col("o.cwd")).alias("project"), _zero(u + "input_tokens").alias("input_tokens"), _zero(u + "output_tokens").alias("output_tokens"), _zero(u + "cache_read_input_tokens").alias("cache_read"), _zero(u + "cache_creation_input_tokens").alias("cache_create"), F.lit(0).cast("long").alias("reasoning"), F.lit("exact").alias("token_accuracy"), F.lit("succeeded").alias("status"), F.col("byte_offset").alias("arrival_seq"))


def _carried(lines: DataFrame) -> DataFrame:
    """Session lines with the session, project and model last named before them in their file."""
    marked = F.col("line").contains('"token_count"') | F.col("line").contains('"session_meta"') | F.col("line").contains('"turn_context"')
    rows = _strict(lines.filter(marked), SESSION)
    block, order = F.floor(F.col("byte_offset") / BLOCK_BYTES), ["byte_offset"]
    meta = F.when((F.col("o.type") == "session_meta") & F.col("o.payload.id").isNotNull(), F.struct(F.col("o.payload.id").alias("id"), last_part(F.col("o.payload.cwd")).alias("project")))
    model = F.when((F.col("o.type") == "turn_context") & (F.col("o.payload.model") != ""), F.col("o.payload.model"))
    rows = carried(carried(rows, ["path"], block, order, meta, "meta"), ["path"], block, order, model, "named")
    return rows.filter("o.type = 'event_msg' and o.payload.type = 'token_count'")


def codex_sessions(lines: DataFrame) -> DataFrame:
    """Calls of session files; without input and output there is no call."""
    u = "o.payload.info.last_token_usage."
    rows = _carried(lines).filter("o.payload.info.last_token_usage is not null").filter((_zero(u + "input_tokens") > 0) | (_zero(u + "output_tokens") > 0))
    return rows.select(F.concat_ws(":", F.lit("codex"), "path", F.col("byte_offset").cast("string")).alias("dedup_key"), _time(F.col("o.timestamp")).alias("ts"), F.lit("codex").alias("provider"), F.lit("codexTranscript").alias("source"), F.coalesce("named", F.lit("Codex")).alias("model"), F.coalesce("meta.id", stem(F.col("path"))).alias("session_id"), F.col("meta.project").alias("project"), _zero(u + "input_tokens").alias("input_tokens"), _zero(u + "output_tokens").alias("output_tokens"), _zero(u + "cached_input_tokens").alias("cache_read"), F.lit(0).cast("long").alias("cache_create"), _zero(u + "reasoning_output_tokens").alias("reasoning"), F.lit("exact").alias("token_accuracy"), F.lit("succeeded").alias("status"), F.col("byte_offset").alias("arrival_seq"))


def codex_quota(lines: DataFrame) -> DataFrame:
    """(ts, arrival_seq, window, percent, minutes, resets_at) readings of session files, also of lines without usage."""
    each = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"o.payload.rate_limits.{n}").alias("v")) for n in ("primary", "secondary")])
    rows = _carried(lines).select(_time(F.col("o.timestamp")).alias("ts"), F.col("byte_offset").alias("arrival_seq"), F.explode(each).alias("r")).filter("r.v.used_percent is not null")
    return rows.select("ts", "arrival_seq", "r.window", F.col("r.v.used_percent").alias("percent"), F.col("r.v.window_minutes").cast("long").alias("minutes"), F.timestamp_seconds("r.v.resets_at").alias("resets_at"))


def _first(text: str, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def lmstudio(lines: DataFrame) -> DataFrame:
    """Prediction outputs; counts may be text; without counts there is no call."""
    s = lambda *names: _first("line", *[f"$.data.stats.{n}" for n in names])
    n = lambda *names: F.coalesce(s(*names).try_cast("double").cast("long"), F.lit(0).cast("long"))
    rows = lines.filter(F.col("line").contains("llm.prediction.output")).filter((F.get_json_object("line", "$.data.type") == "llm.prediction.output") & F.get_json_object("line", "$.data.stats").isNotNull())
    seconds = F.coalesce(epoch_or_iso(F.get_json_object("line", "$.timestamp")), F.unix_micros("mtime") / 1e6)
    out = rows.select(seconds.alias("sec"), _first("line", "$.data.modelIdentifier", "$.data.modelPath").alias("m"), _first("line", "$.data.predictionId", "$.data.id").alias("id"), n("promptTokensCount").alias("input_tokens"), n("predictedTokensCount").alias("output_tokens"), n("reasoningTokensCount", "reasoning_output_tokens").alias("reasoning"), s("stopReason").alias("finish_reason"), s("generationTimeSeconds", "generationTimeSec", "generation_time_seconds").try_cast("double").alias("duration_s"), s("modelLoadTimeSeconds", "model_load_time_seconds").try_cast("double").alias("load_s"), s("timeToFirstTokenSeconds", "timeToFirstTokenSec", "time_to_first_token_seconds").try_cast("double").alias("ttft_s"), s("tokensPerSecond", "tokens_per_second").try_cast("double").alias("tps"), F.col("byte_offset").alias("arrival_seq"))
    out = out.filter("input_tokens > 0 or output_tokens > 0").withColumn("model", F.coalesce("m", F.lit("LM Studio")))
    key = F.coalesce("id", F.concat_ws(":", F.col("sec").cast("string"), "input_tokens", "output_tokens", "model"))
    return out.select(F.concat(F.lit("lmstudio:"), key).alias("dedup_key"), F.timestamp_micros(F.floor(F.col("sec") * 1e6 + 0.5).cast("long")).alias("ts"), F.lit("lmStudio").alias("provider"), F.lit("lmStudioLog").alias("source"), "model", F.concat(F.lit("lmstudio:"), "model").alias("session_id"), "input_tokens", "output_tokens", "reasoning", F.lit("exact").alias("token_accuracy"), F.lit("succeeded").alias("status"), F.lit("local").alias("location"), "finish_reason", "duration_s", "load_s", "ttft_s", "tps", "arrival_seq")


def session_names(lines: DataFrame) -> DataFrame:
    """(session, name): the last title or summary line, else the first real user message, cut to 60 characters."""
    j = lambda p: F.get_json_object("line", p)
    marked = F.col("line").contains('"ai-title"') | F.col("line").contains('"summary"') | F.col("line").contains('"user"')
    rows = lines.filter(marked & ~F.col("line").contains('"assistant"')).select("path", "byte_offset", "mtime", "line", j("$.type").alias("type"), F.coalesce(j("$.sessionId"), stem(F.col("path"))).alias("own"), stem(F.col("path")).alias("file"))
    blocks = F.from_json(j("$.message.content"), "array<struct<type:string,text:string>>")
    first_block = F.try_element_at(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(1))["text"]
    said = F.trim(F.when(j("$.message.content").startswith("["), first_block).otherwise(j("$.message.content")))
    told = F.when(F.col("type") == "ai-title", F.trim(j("$.aiTitle"))).when(F.col("type") == "summary", F.trim(j("$.summary")))
    flat = F.regexp_replace(said, "\n", " ")
    short = F.when(F.length(flat) > 60, F.concat(F.substring(flat, 1, 60), F.lit("…"))).otherwise(flat)
    ok = (F.col("type") == "user") & (F.coalesce(j("$.isMeta"), F.lit("false")) != "true") & (said != "") & ~said.startswith("<") & ~said.startswith("Caveat:")
    out = rows.select(F.when(F.col("type") == "summary", F.col("file")).otherwise(F.col("own")).alias("session"), F.struct("mtime", "path", "byte_offset").alias("at"), F.when(told != "", told).alias("told"), F.when(ok, short).alias("said"))
    return out.groupBy("session").agg(F.max_by("told", F.when(F.col("told").isNotNull(), F.col("at"))).alias("told"), F.min_by("said", F.when(F.col("said").isNotNull(), F.col("at"))).alias("said")).select("session", F.coalesce("told", "said").alias("name")).filter("name is not null")


def desktop_rows(messages: DataFrame, since: str | None = None) -> DataFrame:
    """Finished assistant rows of a desktop database: metadata, no tokens, accuracy unknown; an unknown model stays empty."""
    at = lambda c: F.try_to_timestamp(F.replace(F.col(c), F.lit(" "), F.lit("T")))
    rows = messages.filter("role = 'assistant' and stream = 0").select("id", "chat_id", "model_name", at("created_at").alias("started_at"), at("updated_at").alias("ts")).filter("ts is not null")
    rows = rows.filter(F.col("ts") >= since) if since else rows
    took = F.greatest((F.unix_micros("ts") - F.unix_micros("started_at")) / 1e6, F.lit(0.0))
    zero = [F.lit(0).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create", "reasoning")]
    return rows.select(F.concat(F.lit("ollama-desktop:"), F.col("id").cast("string")).alias("dedup_key"), "ts", "started_at", F.lit("ollama").alias("provider"), F.lit("ollamaDesktop").alias("source"), F.coalesce("model_name", F.lit("")).alias("model"), F.concat(F.lit("ollama-app:"), "chat_id").alias("session_id"), *zero, F.lit("unknown").alias("token_accuracy"), F.lit("succeeded").alias("status"), took.alias("duration_s"), F.col("id").alias("arrival_seq"))


def journal(lines: DataFrame, event_schema: str) -> DataFrame:
    """Events of journal lines {schema: 2, key, event}; lines that do not decode are left out."""
    o = F.from_json("line", f"schema int, key string, event struct<{event_schema}>", {"timestampFormat": MICROS})
    return lines.withColumn("o", o).filter("o.schema = 2 and o.key is not null and o.event is not null").select(F.col("o.key").alias("key"), "o.event.*", F.col("byte_offset").alias("seq"))


def legacy_journal(lines: DataFrame) -> DataFrame:
    """Events of version 1 lines {ts, model, input, output, cacheR, cacheC}; the last of equal keys wins."""
    o = F.from_json("line", "ts double, model string, input bigint, output bigint, cacheR bigint, cacheC bigint")
    rows = lines.withColumn("o", o).filter("o.ts is not null and o.model is not null").select("o.*", "byte_offset")
    keyed = rows.withColumn("dedup_key", F.concat_ws(":", F.lit("legacy-proxy"), F.col("ts").cast("string"), "model", "input", "output"))
    last = keyed.groupBy("dedup_key").agg(F.max_by(F.struct("ts", "model", "input", "output", "cacheR", "cacheC", "byte_offset"), F.col("byte_offset")).alias("e"))
    return last.select("dedup_key", F.timestamp_micros(F.floor(F.col("e.ts") * 1e6 + 0.5).cast("long")).alias("ts"), F.lit("ollama").alias("provider"), F.lit("proxy").alias("source"), F.col("e.model").alias("model"), F.lit("ollama-direct").alias("session_id"), F.col("e.input").alias("input_tokens"), F.col("e.output").alias("output_tokens"), _zero("e.cacheR").alias("cache_read"), _zero("e.cacheC").alias("cache_create"), F.lit("unknown").alias("token_accuracy"), F.lit("succeeded").alias("status"), F.col("e.byte_offset").alias("arrival_seq"))


_DAY = "struct<input:bigint,output:bigint,cache:bigint,reasoning:bigint,calls:bigint>"
_FLAT = (("claudeCode", "claude"), ("codex", "codex"), ("ollama", "ollama"), ("lmStudio", "lmStudio"))


def history(raw: DataFrame) -> DataFrame:
    """(day, provider, input, output, cache, reasoning, calls) of history files raw(json): {days: {day: ...}}, in the present form with
    providers or the flat older one, where a provider with no value above 0 is left out."""
    flat = ",".join(f"{p}{f}:bigint" for _, p in _FLAT for f in ("In", "Out", "Cache"))
    rows = raw.select(F.explode(F.from_json("json", f"days map<string,struct<providers:map<string,{_DAY}>,calls:bigint,{flat}>>").getField("days")).alias("day", "d"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    now = rows.filter("d.providers is not null").select("day", F.explode("d.providers").alias("provider", "v")).select("day", "provider", *[zero(f"v.{c}").alias(c) for c in ("input", "output", "cache", "reasoning", "calls")])
    old = F.array(*[F.struct(F.lit(name).alias("provider"), zero(f"d.{p}In").alias("input"), zero(f"d.{p}Out").alias("output"), zero(f"d.{p}Cache").alias("cache")) for name, p in _FLAT])
    then = rows.filter("d.providers is null").select("day", F.explode(old).alias("v")).filter("v.input > 0 or v.output > 0 or v.cache > 0").select("day", "v.*", F.lit(0).cast("long").alias("reasoning"), F.lit(0).cast("long").alias("calls"))
    return now.unionByName(then).withColumn("day", F.to_date("day"))


def loaded_models(raw: DataFrame) -> DataFrame:
    """(provider, model, size, vram, expires_at) of snapshots raw(provider, json): an array, or an object with models; a failed poll (null) has none."""
    item = "struct<name:string,model:string,identifier:string,modelKey:string,size:bigint,sizeBytes:bigint,size_vram:bigint,expires_at:string>"
    items = F.coalesce(F.from_json(F.when(F.col("json").startswith("["), F.col("json")), f"array<{item}>"), F.from_json("json", f"models array<{item}>").getField("models"))
    rows = raw.select("provider", F.explode(items).alias("m"))
    return rows.select("provider", F.coalesce("m.name", "m.model", "m.identifier", "m.modelKey").alias("model"), F.coalesce("m.size", "m.sizeBytes").alias("size"), F.col("m.size_vram").alias("vram"), F.try_to_timestamp("m.expires_at").alias("expires_at")).filter("model is not null")


def model_fingerprint(models: DataFrame) -> DataFrame:
    """One text for a provider's set of loaded models, whatever their order and expiry."""
    one = F.concat_ws("@", "model", F.coalesce(F.col("size").cast("string"), F.lit("")), F.coalesce(F.col("vram").cast("string"), F.lit("")))
    return models.groupBy("provider").agg(F.array_join(F.sort_array(F.collect_list(one)), "|").alias("fingerprint"))
