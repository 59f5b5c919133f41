"""Geometry of charts and gauges, and colour blending, as columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .format import hex_rgb, oklab

#: A stacked segment's least height; the gauge's start angle, sweep, centre, radius and needle; the cap of a lift of chroma.
LEAST_HEIGHT, START, SWEEP, CENTRE, RADIUS, NEEDLE, LIFT = 1.5, 215.0, 250.0, (10.0, 4.5), 6.5, 0.92, 1.6
#: The published OKLab to sRGB matrices.
_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
STACK = ("lmStudio", "ollama", "codex", "claudeCode")


def segment_heights(most: Column, height: float) -> Column:
    """array<struct<provider, height>> of a slot's provider columns above 0: in proportion to most, none under LEAST_HEIGHT; what that
    and the gaps of 1 add beyond the height is taken from the tallest."""
    values = F.filter(F.array(*[F.struct(F.lit(p).alias("provider"), F.col(p).alias("v")) for p in STACK]), lambda x: x["v"] > 0)
    tall = F.transform(values, lambda x: F.struct(x["provider"].alias("provider"), F.greatest(height * x["v"] / most, F.lit(LEAST_HEIGHT)).alias("height")))
    only = lambda a: F.transform(a, lambda x: x["height"])
    excess = lambda a: F.aggregate(only(a), F.lit(0.0), lambda s, h: s + h) + F.size(a) - 1 - height
    last = lambda a: F.size(a) - F.array_position(F.reverse(only(a)), F.array_max(only(a))).cast("int")
    lower = lambda a: F.transform(a, lambda x, i: F.struct(x["provider"].alias("provider"), F.when((excess(a) > 0) & (i == last(a)), F.greatest(x["height"] - excess(a), F.lit(LEAST_HEIGHT))).otherwise(x["height"]).alias("height")))
    return F.transform(F.array(tall), lower)[0]


def spark_point(place: Column, n: Column, value: Column, most: Column, width: float, height: float) -> tuple[Column, Column]:
    """(x, y) of the slot at `place` of n: over the width, and down from the top."""
    return width * place / F.greatest(n - 1, F.lit(1)), height - height * value / F.greatest(most, F.lit(1))


def gauge_angle(fraction: Column) -> Column:
    return START - SWEEP * F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0))


def needle(fraction: Column) -> tuple[Column, Column]:
    """(x, y) of the needle's end."""
    a = gauge_angle(fraction) * pi / 180
    return CENTRE[0] + F.cos(a) * RADIUS * NEEDLE, CENTRE[1] + F.sin(a) * RADIUS * NEEDLE


def _times(rows: tuple, v: list[Column]) -> list[Column]:
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in rows]


def with_srgb(rows: DataFrame) -> DataFrame:
    """rows(light, a, b) with red, green and blue (0..1). Step by step as columns, so that each is worked out once."""
    lab = [F.col(c) for c in ("light", "a", "b")]
    steps = rows.withColumns({f"_lms{i}": x for i, x in enumerate(_times(_TO_LMS, lab))})
    cubes = [F.pow(F.col(f"_lms{i}"), F.lit(3.0)) for i in range(3)]
    steps = steps.withColumns({f"_u{i}": F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) for i, u in enumerate(_times(_TO_RGB, cubes))})
    v = [F.col(f"_u{i}") for i in range(3)]
    bent = {n: F.when(u <= 0.0031308, 12.92 * u).otherwise(1.055 * F.pow(u, F.lit(1 / 2.4)) - 0.055) for n, u in zip(("red", "green", "blue"), v, strict=True)}
    return steps.withColumns({n: F.when(F.col("light").isNotNull(), c) for n, c in bent.items()}).drop(*[f"_lms{i}" for i in range(3)], *[f"_u{i}" for i in range(3)])


def rgb_hex(rgb: list[Column]) -> Column:
    """RRGGBB of red, green and blue (0..1)."""
    return F.concat(*[F.lpad(F.hex(F.floor(c * 255 + 0.5).cast("long")), 2, "0") for c in rgb])


def with_blend(rows: DataFrame, weights: list[str], colours: list[str]) -> DataFrame:
    """rows with light, a, b of the weighted mean of colours (RRGGBB), its chroma lifted to the mean of theirs, LIFT times at most; null
    without weight."""
    n = range(len(colours))
    steps = rows.withColumn("_total", sum((F.col(w) for w in weights[1:]), F.col(weights[0])).cast("double"))
    steps = steps.withColumns({f"_lab{i}": F.array(*oklab(hex_rgb(F.lit(c)))) for i, c in enumerate(colours)})
    steps = steps.withColumns({f"_chroma{i}": F.hypot(F.col(f"_lab{i}")[1], F.col(f"_lab{i}")[2]) for i in n})
    mean = lambda values: F.when(F.col("_total") > 0, sum((F.col(weights[i]) * values[i] for i in n[1:]), F.col(weights[0]) * values[0]) / F.col("_total"))
    steps = steps.withColumns({c: mean([F.col(f"_lab{i}")[k] for i in n]) for k, c in enumerate(("light", "a", "b"))} | {"_target": mean([F.col(f"_chroma{i}") for i in n])})
    steps = steps.withColumn("_own", F.hypot("a", "b"))
    steps = steps.withColumn("_lift", F.when(F.col("_own") > 1e-4, F.least(F.col("_target") / F.col("_own"), F.lit(LIFT))).otherwise(1.0))
    return steps.withColumns({c: F.col(c) * F.col("_lift") for c in ("a", "b")}).drop("_total", "_target", "_own", "_lift", *[f"_lab{i}" for i in n], *[f"_chroma{i}" for i in n])
