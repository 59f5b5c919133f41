"""Captured HTTP exchanges to usage events.

exchange(conn_id, seq, direction, bytes, ts, closed) is cut into messages by a small framer, one connection and direction after
another in arrival order, in Arrow batches; only the message at hand is held. All else is joins and grouped aggregation over
the framed lines: requests and responses meet by their place on the connection, and counters are largest-so-far per call."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.format import location_of_model, operation_of_path
from ..scratch import written

FRAMED = "conn_id string, direction string, n long, k long, kind string, text string, ts timestamp"
HEAD_LIMIT, LINE_LIMIT, BODY_LIMIT = 128 << 10, 4_000_000, 8 << 20
_STATUS, _SIZE = re.compile(r"[^ ]+ +([+-]?\d{1,18})(?: |$)"), re.compile(rb"\+?([0-9A-Fa-f]{1,15})")


class Framer:
    """One direction of a connection: feed() gives (n, kind, text) of the heads, body lines (responses) or bodies (requests)
    and ends, in order. kind: head, line, body, complete, cut. A head that is no text, or an answer's without a status, is passed over; from a chunk
    without a size or an end on, what follows is body until the connection closes."""

    def __init__(self, request: bool) -> None:
        self.request, self.held = request, b""
        self.parts: list[bytes] = []  # of the line or body at hand; joined once
        self.size = 0
        self.n, self.mode, self.left = 0, "head", 0

    def state(self) -> tuple:
        """What a framer that goes on later needs: STATE."""
        return self.held, b"".join(self.parts), self.size, self.n, self.mode, self.left

    @classmethod
    def resume(cls, request: bool, state: tuple) -> Framer:
        framer = cls(request)
        framer.held, part, framer.size, framer.n, framer.mode, framer.left = state
        framer.parts = [part] if part else []
        return framer

    def feed(self, data: bytes) -> Iterator[tuple[int, str, str]]:
        self.held += data
        while True:
            before = (len(self.held), self.mode)
            yield from self._step()
            if (len(self.held), self.mode) == before:
                return

    def close(self) -> Iterator[tuple[int, str, str]]:
        if self.mode == "close":
            yield from self._end("complete")
        elif self.mode != "head":
            yield from self._end("cut")

    def _step(self) -> Iterator[tuple[int, str, str]]:
        if self.mode == "head":
            end = self.held.find(b"\r\n\r\n")
            if end < 0:
                if len(self.held) > HEAD_LIMIT:
                    self.held = b""
                return
            head, self.held = self.held[:end], self.held[end + 4 :]
            try:
                head = head.decode()
            except UnicodeDecodeError:
                return
            yield from self._begin(head)
        elif self.mode in ("fixed", "chunk", "close"):
            take = len(self.held) if self.mode == "close" else min(self.left, len(self.held))
            part, self.held = self.held[:take], self.held[take:]
            self.left -= take
            yield from self._body(part)
            if self.mode == "fixed" and not self.left:
                yield from self._end("complete")
            elif self.mode == "chunk" and not self.left:
                self.mode = "gap"
        elif self.mode == "gap" and len(self.held) >= 2:
            whole = self.held.startswith(b"\r\n")
            self.mode, self.held = ("size", self.held[2:]) if whole else ("close", self.held)
        elif self.mode in ("size", "trailer") and (end := self.held.find(b"\r\n")) >= 0:
            line, self.held = self.held[:end], self.held[end + 2 :]
            if self.mode == "size":
                told = _SIZE.fullmatch(line.split(b";")[0].strip(b" \t"))
                self.left = int(told[1], 16) if told else 0
                self.mode = "close" if not told else "chunk" if self.left else "trailer"
            elif not line:
                yield from self._end("complete")

    def _begin(self, head: str) -> Iterator[tuple[int, str, str]]:
        first, _, rest = head.partition("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest.split("\r\n"))}
        told = None if self.request else _STATUS.match(first.lstrip(" "))
        code = int(told[1]) if told else 0
        if not self.request and (not told or 100 <= code < 200):  # no answer, or an interim one, which takes no request
            return
        yield self.n, "head", head
        if code in (204, 304):
            yield from self._end("complete")
        elif "chunked" in fields.get("transfer-encoding", "").lower():
            self.mode = "size"
        elif fields.get("content-length", "").isdigit():
            self.mode, self.left = "fixed", int(fields["content-length"])
            if not self.left:
                yield from self._end("complete")
        elif self.request:
            yield from self._end("complete")
        else:
            self.mode = "close"

    def _body(self, part: bytes) -> Iterator[tuple[int, str, str]]:
        """A response's lines as they end; a line over LINE_LIMIT is left out. A request over BODY_LIMIT has no body."""
        if not self.request and b"\n" in part:
            *lines, part = part.split(b"\n")
            begun, self.parts = self.parts, []
            lines[0] = b"".join([*begun, lines[0]]) if self.size + len(lines[0]) <= LINE_LIMIT else None
            self.size = 0
            for x in lines:
                if x is not None and len(x) <= LINE_LIMIT:
                    yield self.n, "line", x.decode("utf-8", "replace")
        self.size += len(part)  # beyond the limit it only counts, until the line or body ends
        if self.request:
            self.parts = [] if self.size > BODY_LIMIT else self.parts
            if self.size <= BODY_LIMIT:
                self.parts.append(part)
        elif self.size > LINE_LIMIT:
            self.parts = []
        else:
            self.parts.append(part)

    def _end(self, how: str) -> Iterator[tuple[int, str, str]]:
        if text := b"".join(self.parts):
            yield self.n, "body" if self.request else "line", text.decode("utf-8", "replace")
        yield self.n, how, ""
        self.parts, self.size, self.mode, self.n = [], 0, "head", self.n + 1


STATE = "held binary, part binary, size long, n long, mode string, left long, k long, ts timestamp"


def framed(exchange: DataFrame) -> DataFrame:
    """Heads, lines and ends of every message of exchange. A connection's pieces are read in order from sorted batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, framer, k, stamp = None, None, 0, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.conn_id, row.direction) != at:
                    if framer:
                        out += [(*at, n, (k := k + 1), kind, text, stamp) for n, kind, text in framer.close()]
                    at, framer, k = (row.conn_id, row.direction), Framer(row.direction == "request"), 0
                stamp = row.ts
                out += [(*at, n, (k := k + 1), kind, text, stamp) for n, kind, text in framer.feed(row.bytes or b"")]
                if row.closed:
                    out += [(*at, n, (k := k + 1), kind, text, stamp) for n, kind, text in framer.close()]
            yield pd.DataFrame(out, columns=["conn_id", "direction", "n", "k", "kind", "text", "ts"])
        if framer:
            yield pd.DataFrame([(*at, n, (k := k + 1), kind, text, stamp) for n, kind, text in framer.close()], columns=["conn_id", "direction", "n", "k", "kind", "text", "ts"])

    own = exchange.select("conn_id", "direction", "seq", "bytes", "ts", F.coalesce("closed", F.lit(False)).alias("closed"))
    return own.repartition("conn_id").sortWithinPartitions("conn_id", "direction", "seq").mapInPandas(run, FRAMED)


def _header(head: Column, name: str) -> Column:
    found = F.trim(F.regexp_extract(head, rf"(?im)^(?:{name}):[ \t]*([^\r\n]*)", 1))
    return F.when(found != "", found)


def requests(frames: DataFrame) -> DataFrame:
    """(conn_id, n, method, path, model, stream, operation, location, request_id, started_at)."""
    own = frames.filter("direction = 'request'").groupBy("conn_id", "n").agg(F.max(F.when(F.col("kind") == "head", F.col("text"))).alias("head"), F.max(F.when(F.col("kind") == "body", F.col("text"))).alias("body"), F.min("ts").alias("started_at"))
    words = F.split(F.substring_index("head", "\r\n", 1), " ")
    model = F.get_json_object("body", "$.model")
    path = F.substring_index(F.coalesce(F.get(words, F.lit(1)), F.lit("/")), "?", 1)
    return own.select("conn_id", "n", words[0].alias("method"), path.alias("path"), model.alias("model"), (F.coalesce(F.get_json_object("body", "$.stream"), F.lit("false")) == "true").alias("stream"), operation_of_path(path).alias("operation"), F.coalesce(location_of_model(model), F.lit("local")).alias("location"), _header(F.col("head"), "x-request-id|request-id").alias("request_id"), "started_at")


#: Types and objects of stream lines that carry output, end a call, or fail it.
DELTAS = ("content_block_delta", "response.output_text.delta", "response.reasoning_text.delta")
DELTA_OBJECTS = ("chat.completion.chunk", "text_completion")
ENDS = ("message_stop", "message", "response.completed")


def calls(frames: DataFrame) -> DataFrame:
    """One row for each response: tokens, timing, status. An error of null is none; a call ends once, at its first end mark. The frames are
    written once, and so is what the lines say, each parsed once."""
    frames = written(frames, "frames")
    asked = requests(frames)
    lines = frames.filter("direction = 'response'").join(asked.select("conn_id", "n", "operation", "started_at"), ["conn_id", "n"], "left")
    body = F.trim(F.regexp_replace("text", r"[\r\n]", ""))
    body = F.when(body.startswith("data:"), F.trim(F.substring(body, 6, 1 << 30))).otherwise(body)
    rows = lines.withColumn("body", F.when(F.col("kind") == "line", body))
    rows = rows.withColumn("j", F.when(F.col("body").startswith("{"), F.try_parse_json("body")))
    j = lambda *p: F.coalesce(*[F.try_variant_get("j", f"$.{x}", "string") for x in p])
    there = lambda p: F.try_variant_get("j", f"$.{p}", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get("j", f"$.{p}", "variant"))
    num = lambda p: F.try_variant_get("j", f"$.{p}", "string").try_cast("double").cast("long")
    salvage = lambda *names: F.greatest(*[F.regexp_extract("body", rf'"{x}":\s*(\d+)', 1).try_cast("long") for x in names]) if len(names) > 1 else F.regexp_extract("body", rf'"{names[0]}":\s*(\d+)', 1).try_cast("long")
    broken = F.col("body").startswith("{") & F.col("j").isNull() & F.col("body").rlike(r'tokens":|eval_count":|"done":')
    kind, obj = j("type"), j("object")
    in_usage = lambda key: [num(f"{at}.{key}") for at in ("usage", "message.usage", "response.usage")]
    native = j("done").eqNullSafe(F.lit("true")) | (there("embeddings") & (F.col("operation") == "embedding"))
    most = lambda *c: F.greatest(F.lit(None).cast("long"), *c)
    error = there("error") & ~j("error").eqNullSafe(F.lit("null"))
    delta = F.coalesce(kind.isin(*DELTAS), F.lit(False)) | F.coalesce(obj.isin(*DELTA_OBJECTS), F.lit(False)) | j("done").eqNullSafe(F.lit("false"))
    ends = F.coalesce(kind.isin(*ENDS), F.lit(False)) | (obj == "chat.completion") | ((obj == "list") & (F.col("operation") == "embedding")) | ((obj == "response") & (j("status") == "completed")) | native | (F.col("body") == "[DONE]") | (broken & F.col("body").rlike(r'"done":true|"type":"message_stop"'))
    parsed = written(rows.select(
        "conn_id", "n", "k", "kind", "text", "ts", "started_at",
        most(*in_usage("input_tokens"), *in_usage("prompt_tokens"), F.when(native, num("prompt_eval_count")), F.when(broken, salvage("prompt_eval_count", "input_tokens", "prompt_tokens"))).alias("input"),
        most(*in_usage("output_tokens"), *in_usage("total_output_tokens"), *in_usage("completion_tokens"), F.when(native, num("eval_count")), F.when(broken, salvage("eval_count", "output_tokens", "completion_tokens"))).alias("output"),
        most(*in_usage("cache_read_input_tokens"), *in_usage("input_tokens_details.cached_tokens")).alias("cache_read"), most(*in_usage("cache_creation_input_tokens")).alias("cache_create"),
        most(*in_usage("reasoning_output_tokens"), *in_usage("output_tokens_details.reasoning_tokens")).alias("reasoning"),
        F.coalesce(delta, F.lit(False)).alias("delta"), F.coalesce(ends, F.lit(False)).alias("ends"), F.coalesce(error | kind.isin("response.failed", "error"), F.lit(False)).alias("error"),
        j("model", "message.model", "response.model").alias("model"), j("message.id", "response.id", "id").alias("id"),
        j("delta.stop_reason", "stop_reason", "choices[0].finish_reason", "done_reason", "response.incomplete_details.reason").alias("reason"),
        *[F.when(native, num(f"{c}_duration") / 1e9).alias(f"{c}_s") for c in ("total", "load", "prompt_eval", "eval")],
    ), "lines")
    code = F.when(F.col("kind") == "head", F.regexp_extract("text", r"^\S+ (\d{3})", 1).try_cast("int"))
    # what follows the first end or error belongs to no call
    first_end = F.min(F.when(F.col("ends") | F.col("error"), F.col("k")))
    stops = parsed.groupBy("conn_id", "n").agg(first_end.alias("stop"))
    kept = parsed.join(stops, ["conn_id", "n"]).filter("stop is null or k <= stop or kind in ('complete', 'cut')")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("k")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("k")))
    one = kept.groupBy("conn_id", "n").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("input", "output", "cache_read", "cache_create", "reasoning")],
        F.count_if("delta").alias("approx_output"), (F.max("input").isNotNull() | F.max("output").isNotNull()).alias("saw_usage"),
        F.bool_or("error").alias("error"), F.bool_or("ends").alias("ended"), F.bool_or(F.col("kind") == "cut").alias("cut"), F.max(code).alias("http_status"),
        last("model").alias("model"), first("id").alias("response_id"), last("reason").alias("finish_reason"), *[F.max(f"{c}_s").alias(f"{c}_s") for c in ("total", "load", "prompt_eval", "eval")],
        F.min(F.when(F.col("delta"), F.col("ts"))).alias("first_ts"), F.max("ts").alias("ts"), F.min("started_at").alias("started_at"),
    )
    bad = F.coalesce(F.col("http_status") >= 400, F.lit(False))
    state = F.when(bad | F.col("error"), "failed").when(F.col("ended"), "succeeded").when(F.col("cut"), "cancelled").when(F.col("saw_usage"), "succeeded").otherwise("cancelled")
    category = F.when(F.col("http_status").isNotNull() & (bad | F.col("error")), F.concat(F.lit("http_"), F.col("http_status").cast("string"))).when(F.col("error"), "provider_error")
    seconds = lambda a, b: F.greatest((F.unix_micros(a) - F.unix_micros(b)) / 1e6, F.lit(0.0))
    out = one.join(asked.withColumnRenamed("model", "asked_model").drop("started_at"), ["conn_id", "n"], "left")
    return out.select(
        "conn_id", "n", "method", "path", "operation", "location", F.coalesce("model", "asked_model").alias("model"), F.coalesce("response_id", "request_id").alias("request_id"), "input", "output", "cache_read", "cache_create", "reasoning", "approx_output",
        F.when(F.col("output") > 0, F.col("output")).otherwise(F.col("approx_output")).alias("display_output"), "saw_usage", state.alias("status"), category.alias("error_category"), "http_status", "finish_reason",
        F.coalesce("total_s", seconds("ts", "started_at")).alias("duration_s"), "load_s", "prompt_eval_s", "eval_s", F.when(F.col("first_ts").isNotNull(), seconds("first_ts", "started_at")).alias("ttft_s"),
        F.when((F.col("output") > 0) & (F.col("eval_s") > 0), F.col("output") / F.col("eval_s")).alias("tps"), "ts", "started_at",
    )


def as_events(found: DataFrame) -> DataFrame:
    """Proxy observations of finished calls: those with tokens or a failure. Only counted output is estimated."""
    kept = found.filter("output > 0 or approx_output > 0 or input > 0 or status = 'failed'")
    accuracy = F.when(F.col("saw_usage"), "exact").when(F.col("approx_output") > 0, "estimated").otherwise("unknown")
    return kept.select(F.concat_ws(":", F.lit("proxy"), "conn_id", F.col("n").cast("string")).alias("dedup_key"), "ts", "started_at", F.lit("ollama").alias("provider"), F.lit("proxy").alias("source"), "model", F.lit("ollama-direct").alias("session_id"), F.col("input").alias("input_tokens"), F.col("display_output").alias("output_tokens"), "cache_read", "cache_create", "reasoning", accuracy.alias("token_accuracy"), "operation", "status", "location", F.col("path").alias("endpoint"), "request_id", "http_status", "finish_reason", "error_category", "duration_s", "load_s", "prompt_eval_s", "eval_s", "ttft_s", "tps")
