"""Texts that stand beside numbers, as columns. The wording is fixed; numbers round half up in decimal places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .format import compact

#: Names of providers, and what an operation is called.
NAMES = {"claudeCode": "Claude", "codex": "Codex", "ollama": "Ollama", "lmStudio": "LM Studio"}
OPERATION_LABELS = {"chat": "chat", "generate": "generate", "completion": "completion", "responses": "responses", "embedding": "embedding", "image": "image"}
#: States of a runtime, their labels and colours.
STATES = {"unavailable": "Not available", "installed": "Installed · not connected", "connecting": "Connecting…", "connected": "Connected", "degraded": "Degraded"}
STATE_COLOURS = {"connected": "green", "installed": "orange", "connecting": "orange", "degraded": "orange", "unavailable": "gray"}
#: Red, green and blue (0..255) of each severity.
SEVERITY_RGB = {"healthy": (48, 184, 92), "warning": (232, 152, 27), "danger": (229, 72, 77)}
DOT = " · "


def chosen(value: Column, texts: dict[str, str], other: Column | None = None) -> Column:
    out = F.lit(None).cast("string") if other is None else other
    for name, text in texts.items():
        out = F.when(value == name, F.lit(text)).otherwise(out)
    return out


def display_name(provider: Column) -> Column:
    return chosen(provider, NAMES, provider)


def operation_label(operation: Column) -> Column:
    return chosen(operation, OPERATION_LABELS, F.lit("inference"))


def accuracy_prefix(accuracy: Column) -> Column:
    return F.when(accuracy == "estimated", "~").otherwise("")


def fixed(value: Column, places: int) -> Column:
    """value >= 0 with so many decimal places, half up."""
    n = F.floor(value * 10**places + 0.5).cast("long")
    return F.concat(F.floor(n / 10**places).cast("long").cast("string"), F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0"))


def percent(utilization: Column) -> Column:
    """Rounded half up, for display; alerts cut instead."""
    return F.floor(utilization + 0.5).cast("long")


def _when(condition: Column, *parts: Column | str) -> Column:
    """The parts joined if the condition holds; else null, which concat_ws leaves out."""
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def calls(n: Column) -> Column:
    """1 call, 2,054 calls."""
    return F.when(n == 1, "1 call").otherwise(F.concat(F.format_number(n, 0), F.lit(" calls")))


def call_detail() -> Column:
    """A call's tokens and speed, of an event's columns."""
    speed = F.coalesce(_when(F.col("tps").isNotNull(), DOT, fixed(F.col("tps"), 1), " t/s"), _when(F.col("duration_s").isNotNull(), DOT, fixed(F.col("duration_s"), 1), "s"), F.lit(""))
    cache = F.coalesce(_when(F.col("cache_read") > 0, " +", compact(F.col("cache_read")), " cache"), F.lit(""))
    unknown = (F.col("token_accuracy") == "unknown") & (F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)
    counted = F.concat(F.lit("↑ "), compact(F.col("input_tokens")), cache, F.lit("  ↓ "), accuracy_prefix(F.col("token_accuracy")), compact(F.col("output_tokens")), speed)
    failed = F.coalesce(_when(F.col("http_status").isNotNull(), "failed", DOT, F.col("http_status").cast("string")), F.lit("failed"))
    return F.when(F.col("status") == "failed", failed).when(unknown, F.concat(F.lit("tokens unavailable"), speed)).otherwise(counted)


def call_help() -> Column:
    """All that is known of a call, of an event's columns."""
    none = (F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)
    tokens = F.when((F.col("token_accuracy") == "unknown") & none, "token counts unavailable").when(F.col("token_accuracy") == "unknown", "token accuracy unknown").otherwise(F.concat("token_accuracy", F.lit(" tokens")))
    return F.concat_ws(
        DOT, display_name(F.col("provider")), operation_label(F.col("operation")), "status", tokens, _when(F.col("duration_s").isNotNull(), fixed(F.col("duration_s"), 2), "s duration"),
        _when(F.col("ttft_s").isNotNull(), fixed(F.col("ttft_s"), 2), "s TTFT"), _when(F.col("tps").isNotNull(), fixed(F.col("tps"), 1), " tokens/s"), "error_category",
    )


def loaded_model_detail() -> Column:
    """Of columns provider, generating, queued, vram, size, context, parallel; gigabytes are 10^9 bytes, video memory comes first."""
    memory = F.when(F.col("vram") > 0, F.concat(fixed(F.col("vram") / 1e9, 1), F.lit(" GB VRAM"))).when(F.col("size") > 0, F.concat(fixed(F.col("size") / 1e9, 1), F.lit(" GB")))
    return F.concat_ws(DOT, display_name(F.col("provider")), F.when(F.col("generating"), "generating"), _when(F.col("queued") > 0, F.col("queued").cast("string"), " queued"), memory, _when(F.col("context") > 0, compact(F.col("context")), " ctx"), _when(F.col("parallel") > 1, F.col("parallel").cast("string"), " parallel"))


def model_detail() -> Column:
    """Of totals: unmetered calls are said to be so, never shown as zero tokens."""
    some = F.coalesce(_when(F.col("unmetered") > 0, DOT, F.col("unmetered").cast("string"), " unmetered"), F.lit(""))
    counted = F.concat(F.lit("↑ "), compact(F.col("input_tokens")), F.lit("  ↓ "), compact(F.col("output_tokens")), F.lit("  · "), calls(F.col("calls")), some)
    return F.when(F.col("unmetered") == F.col("calls"), F.concat(F.lit("no token data · "), calls(F.col("calls")))).otherwise(counted)


def provider_detail() -> Column:
    """Of totals: a provider's metrics; a dash without calls."""
    counted = F.concat_ws(" ", F.concat(F.lit("↑ "), compact(F.col("input_tokens"))), _when(F.col("cache_read") > 0, "+", compact(F.col("cache_read")), " cache"), F.concat(F.lit("↓ "), compact(F.col("output_tokens"))), _when(F.col("reasoning") > 0, "· ", compact(F.col("reasoning")), " reasoning"), _when(F.col("unmetered") > 0, "· ", F.col("unmetered").cast("string"), " unmetered"))
    return F.when(F.col("calls") == 0, "—").when(F.col("unmetered") == F.col("calls"), "tokens unavailable").otherwise(counted)


def session_detail() -> Column:
    """Of sessions(): up to two models are named, more are counted."""
    models = F.when(F.col("n_models") == 0, None).when(F.col("n_models") <= 2, F.replace("models", F.lit(","), F.lit(", "))).otherwise(F.concat(F.col("n_models").cast("string"), F.lit(" models")))
    metered = F.col("unmetered") != F.col("calls")
    return F.concat_ws(
        DOT, "project", models, calls(F.col("calls")), F.when(~metered, "no token data"), _when(metered, "↑ ", compact(F.col("input_tokens"))), _when(metered & (F.col("cache_read") > 0), "+", compact(F.col("cache_read")), " cache"),
        _when(metered, "↓ ", compact(F.col("output_tokens"))), _when(metered & (F.col("reasoning") > 0), compact(F.col("reasoning")), " reasoning"),
    )


def performance_detail() -> Column:
    """Of performance.by_model(): medians and failures; the number of calls if there is neither."""
    found = F.concat_ws(DOT, _when(F.col("median_tps").isNotNull(), fixed(F.col("median_tps"), 1), " tok/s"), _when(F.col("median_ttft_s").isNotNull(), fixed(F.col("median_ttft_s"), 2), "s TTFT"), _when(F.col("failed") > 0, F.col("failed").cast("string"), " failed"))
    return F.when(found == "", F.concat(F.col("calls").cast("string"), F.lit(" calls"))).otherwise(found)


def health_label(port: int) -> Column:
    """Of columns provider, state, server (it runs), collector (it runs)."""
    both, server, collector = F.col("server") & F.col("collector"), F.col("server"), F.col("collector")
    ollama = F.when(both, f"Daemon reachable · proxy listening on {port}").when(collector, "Proxy listening · Ollama daemon unavailable").when(server, "Daemon reachable · proxy unavailable")
    studio = F.when(both, "Telemetry connected · API server running").when(collector, "Telemetry connected · API server stopped").when(server, "API server running · telemetry disconnected")
    return F.coalesce(F.when(F.col("provider") == "ollama", ollama).when(F.col("provider") == "lmStudio", studio), chosen(F.col("state"), STATES))


def health_colour(state: Column) -> Column:
    return chosen(state, STATE_COLOURS)


def version_label(provider: Column, version: Column) -> Column:
    """With a v before it, but not LM Studio's."""
    return F.when((provider == "lmStudio") | F.lower(version).startswith("v"), version).otherwise(F.concat(F.lit("v"), version))


def severity_rgb(severity: Column) -> Column:
    """struct<r, g, b> of 0..255."""
    parts = [chosen(severity, {s: str(rgb[i]) for s, rgb in SEVERITY_RGB.items()}).cast("int").alias(c) for i, c in enumerate("rgb")]
    return F.struct(*parts)


def slot_label(ts: Column, period: str) -> Column:
    """The hour of a slot of today, else weekday, month and day."""
    return F.date_format(ts, "HH:00") if period == "today" else F.date_format(ts, "EEE MMM d")


def short_day(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def bar_tooltip(label: Column, include_cache: bool) -> Column:
    """Of a slot's provider columns."""
    parts = [F.concat(F.lit(f"{name} "), compact(F.col(p))) for p, name in NAMES.items()]
    return F.concat(label, F.lit(": "), F.concat_ws(DOT, *parts), F.lit(" (incl. cache)" if include_cache else ""))


def grid_tooltip(day: Column, total: Column, today: Column, include_cache: bool) -> Column:
    """Of a day of the activity grid, from its provider columns; empty for days to come."""
    parts = [F.concat(F.lit(f"{name} "), compact(F.col(p))) for p, name in NAMES.items()]
    told = F.concat(slot_label(day, "month"), F.lit(": "), compact(total), F.lit(" tokens ("), F.concat_ws(DOT, *parts), F.lit(")" + (f"{DOT}incl. cache" if include_cache else "")))
    return F.when(day > today, "").otherwise(told)


def quota_tooltip(label: Column, utilization: Column, nearest: Column) -> Column:
    """Of a limit cell: its share rounded to a whole percent, and whether it is the nearest to its limit."""
    return F.concat(label, F.lit(": "), percent(utilization).cast("string"), F.lit("% used"), F.when(nearest, ", nearest limit").otherwise(""))


def edge_labels(first: Column, last: Column, as_of: str, period: str) -> tuple[Column, Column]:
    """Labels of a chart's first and last slot."""
    if period == "today":
        return F.lit("00:00"), F.lit("now")
    return short_day(first), F.when(F.to_date(last) == F.to_date(F.lit(as_of)), "today").otherwise(short_day(last))
