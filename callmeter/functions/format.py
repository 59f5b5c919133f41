"""Scalar rules as column expressions: labels, parsing of loose values, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(n: Column) -> Column:
    """999, 1.5k, 120k, 1.25M. Rounds half up in whole numbers."""
    tenth, whole, hundredth = F.floor((n + 50) / 100), F.floor((n + 500) / 1000), F.floor((n + 5000) / 10000)
    point = lambda v, by, width: F.concat(F.floor(v / by).cast("string"), F.lit("."), F.lpad((v % by).cast("string"), width, "0"))
    return F.when(n < 1000, n.cast("string")).when(n < 100_000, F.concat(point(tenth, 10, 1), F.lit("k"))).when(n < 1_000_000, F.concat(whole.cast("string"), F.lit("k"))).otherwise(F.concat(point(hundredth, 100, 2), F.lit("M")))


def until(seconds: Column) -> Column:
    """How long until a reset: now, in 5m, in 2h 5m, in 1d 3h."""
    minutes = F.floor(seconds / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    join = lambda *parts: F.concat(F.lit("in "), *parts)
    text = lambda v, unit: F.concat(v.cast("string"), F.lit(unit))
    return F.when(seconds <= 0, "now").when(hours >= 24, join(text(F.floor(hours / 24).cast("long"), "d "), text(hours % 24, "h"))).when(hours > 0, join(text(hours, "h "), text(minutes % 60, "m"))).otherwise(join(text(minutes, "m")))


def window_label(minutes: Column, zero_is_limit: bool = True) -> Column:
    """7d, 5h, 30m; limit if unknown (and, unless zero_is_limit is false, if not positive: then 0 is 0m)."""
    unknown = minutes.isNull() | (minutes <= 0) if zero_is_limit else minutes.isNull()
    text = lambda v, unit: F.concat(F.floor(v).cast("long").cast("string"), F.lit(unit))
    return F.when(unknown, "limit").when((minutes >= 1440) & (minutes % 1440 == 0), text(minutes / 1440, "d")).when((minutes >= 60) & (minutes % 60 == 0), text(minutes / 60, "h")).otherwise(text(minutes, "m"))


def severity(utilization: Column) -> Column:
    """Under 60 healthy, up to 85 warning, above danger."""
    return F.when(utilization < 60, "healthy").when(utilization <= 85, "warning").otherwise("danger")


def fraction(utilization: Column) -> Column:
    return F.least(F.greatest(utilization / 100, F.lit(0.0)), F.lit(1.0))


def provider_of_model(model: Column) -> Column:
    return F.when(F.lower(model).startswith("claude"), "claudeCode").otherwise("ollama")


def location_of_model(model: Column) -> Column:
    low = F.lower(model)
    return F.when(low.contains(":cloud") | low.endswith("-cloud"), "cloud").otherwise("local")


#: Request paths and their operations.
OPERATIONS = {"/api/chat": "chat", "/v1/chat/completions": "chat", "/v1/messages": "chat", "/api/generate": "generate", "/v1/completions": "completion", "/v1/responses": "responses", "/api/embed": "embedding", "/api/embeddings": "embedding", "/v1/embeddings": "embedding", "/v1/images/generations": "image"}


def operation_of_path(path: Column) -> Column:
    plain, out = F.substring_index(path, "?", 1), F.lit("unknown")
    for at, name in OPERATIONS.items():
        out = F.when(plain == at, name).otherwise(out)
    return out


def epoch_or_iso(text: Column, least: float = 0.0) -> Column:
    """Seconds since 1970 of epoch seconds, epoch milliseconds (above 1e10) or ISO text; null otherwise."""
    n = text.try_cast("double")
    parsed = F.try_to_timestamp(text)
    return F.when(n.isNotNull() & (n > least), F.when(n > 1e10, n / 1000).otherwise(n)).otherwise(F.unix_micros(parsed) / 1e6)


def tokens_per_second(output: Column, eval_ns: Column) -> Column:
    return F.when((output > 0) & (eval_ns > 0), output / (eval_ns / 1e9))


def heat_opacity(total: Column, most: Column) -> Column:
    """From 0.32 for the least to 1 for the most, by the square root; 0 for nothing."""
    return F.when(total > 0, F.round(0.32 + 0.68 * F.sqrt(F.least(F.lit(1.0), total / most)), 6)).otherwise(0.0)


def hex_rgb(text: Column) -> Column:
    """struct<r, g, b> of 0..1 of RRGGBB."""
    part = lambda at: F.conv(F.substring(text, at, 2), 16, 10).cast("double") / 255
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


#: The published sRGB to OKLab matrices.
_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def _times(rows: tuple, v: list[Column]) -> list[Column]:
    return [sum((x * c for x, c in zip(r[1:], v[1:], strict=True)), r[0] * v[0]) for r in rows]


def oklab(rgb: Column) -> list[Column]:
    """L, a, b of struct<r, g, b>."""
    return _times(_TO_LAB, [F.cbrt(x) for x in _times(_TO_LMS, [_linear(rgb[k]) for k in "rgb"])])
