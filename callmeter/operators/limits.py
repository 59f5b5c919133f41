"""Plan limits: windows of quota readings, their order and severity, and alerts at thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.format import epoch_or_iso, fraction, severity, window_label
from ..scratch import written
from .ordered import by_time, previous

#: The order of the rail, and the thresholds of short and long windows.
RAIL = ("codex-primary", "codex-secondary", "claude-primary", "claude-secondary")
BANDS = {"session": (25, 50, 75, 90), "primary": (25, 50, 75, 90), "weekly": (50, 75, 90), "secondary": (50, 75, 90), "sonnet": (50, 75, 90)}
#: Keys of the account usage object and their windows.
ACCOUNT_WINDOWS = (("five_hour", "session", 300), ("seven_day", "weekly", 10080), ("seven_day_sonnet", "sonnet", 10080))


def account_windows(raw: DataFrame) -> DataFrame:
    """(account, window, utilization, resets_at, minutes) of raw(account, json); a missing key gives no row, a missing utilization 0."""
    part = "struct<utilization:double,resets_at:string>"
    parsed = raw.withColumn("o", F.from_json("json", ",".join(f"{k} {part}" for k, _, _ in ACCOUNT_WINDOWS)))
    each = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"o.{k}").alias("v"), F.lit(m).alias("minutes")) for k, w, m in ACCOUNT_WINDOWS])
    return parsed.select("account", F.explode(each).alias("w")).filter("w.v is not null").select("account", "w.window", F.coalesce("w.v.utilization", F.lit(0.0)).alias("utilization"), epoch_or_iso(F.col("w.v.resets_at")).alias("resets_at"), "w.minutes")


def quota_walk(raw: DataFrame) -> DataFrame:
    """(account, percent, minutes, resets_at): the percent-bearing objects of raw(account, json) at any nesting,
    first occurrence of each, the two shortest windows of an account; percents outside 0..100 are left out."""
    spark = raw.sparkSession
    level = written(raw.select("account", F.try_parse_json("json").alias("v"), F.lit("").alias("at")).filter("v is not null"), "walk")
    seen = []
    while not level.isEmpty():  # each level of nesting is a table, so none is parsed twice
        seen.append(level)
        below = spark.sql("select account, c.value as v, concat(at, '/', lpad(cast(c.pos as string), 6, '0')) as at from {level}, lateral variant_explode(v) c", level=level)
        level = written(below.filter("v is not null and (schema_of_variant(v) like 'OBJECT%' or schema_of_variant(v) like 'ARRAY%')"), "walk")
    seen = reduce(DataFrame.unionByName, seen or [level])
    get = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    seconds = get("window_seconds", "window_duration_seconds", "limit_window_seconds").try_cast("double")
    found = seen.filter(F.schema_of_variant("v").startswith("OBJECT")).select("account", "at", get("used_percent", "utilization").try_cast("double").alias("percent"), F.coalesce(get("window_minutes").try_cast("double"), seconds / 60).cast("long").alias("minutes"), epoch_or_iso(get("resets_at", "reset_at", "reset_time"), 1e9).alias("resets_at"))
    found = found.filter(F.col("percent").between(0, 100)).groupBy("account", "percent", "minutes", "resets_at").agg(F.min("at").alias("at"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("account").orderBy(F.asc_nulls_last("minutes"), "at")))
    return ranked.filter("rank <= 2").select("account", "percent", "minutes", "resets_at", F.when(F.col("rank") == 1, "primary").otherwise("secondary").alias("window"))


def latest(observations: DataFrame) -> DataFrame:
    """The newest reading of each account and window; on equal times the later arrival."""
    best = F.max_by(F.struct(*observations.columns), F.struct("ts", "arrival_seq"))
    return observations.groupBy("account", "window").agg(best.alias("b")).select("b.*")


def readings(windows: DataFrame) -> DataFrame:
    """Windows with label, severity and clamped fraction."""
    return windows.withColumn("label", window_label(F.col("minutes"))).withColumn("severity", severity(F.col("utilization"))).withColumn("fraction", fraction(F.col("utilization")))


def _place(id_: Column) -> Column:
    out = F.lit(len(RAIL))
    for i, name in enumerate(RAIL):
        out = F.when(id_ == name, i).otherwise(out)
    return out


def rail(windows: DataFrame) -> DataFrame:
    """The four rail cells in display order: (place, id, ...)."""
    return readings(windows).filter(F.col("id").isin(*RAIL)).withColumn("place", _place(F.col("id")))


def nearest(windows: DataFrame) -> DataFrame:
    """The cell nearest to its limit; on ties the first in display order."""
    return rail(windows).orderBy(F.desc("utilization"), "place", "id").limit(1)


def bands(window: Column) -> Column:
    out = F.lit(None).cast("array<int>")
    for name, values in BANDS.items():
        out = F.when(window == name, F.array(*[F.lit(v) for v in values])).otherwise(out)
    return out


def top_band() -> Column:
    """The highest band not above a reading's percent, 0 if none."""
    return F.coalesce(F.array_max(F.filter(bands(F.col("window")), lambda b: b <= F.col("percent"))), F.lit(0))


def crossed(told: DataFrame) -> DataFrame:
    """The alerts of readings with their band and the band of the reading before (last)."""
    return told.filter(F.col("band") > F.coalesce("last", F.lit(0))).select("account", "window", "ts", "percent", F.col("band").cast("long").alias("band"), F.concat("account", F.lit("-"), "window", F.lit("-"), F.col("band").cast("string")).alias("alert_id"))


def threshold_alerts(history: DataFrame) -> DataFrame:
    """(account, window, ts, percent, band, alert_id) of history(account, window, ts, arrival_seq, percent): a band is told once when it
    is crossed; a drop re-arms to the highest band not above the percent. On equal times the earlier arrival comes first."""
    # the state after a reading is the highest band at or below its percent, whether it rose or fell: so the reading before decides
    return crossed(previous(history.withColumn("band", top_band()), ["account", "window"], F.to_date("ts"), by_time(history), F.col("band"), "last"))


#: Titles and texts of alerts, by window; {label} is the window's, {band} the band crossed, {used} the whole percent.
ALERTS = {
    "session": ("Claude session limit {band}%", "You've used {used}% of your 5-hour session limit.", "limit-session-{band}"),
    "weekly": ("Claude weekly limit {band}%", "You've used {used}% of your weekly limit.", "limit-weekly-{band}"),
    "sonnet": ("Claude weekly Sonnet limit {band}%", "You've used {used}% of your weekly Sonnet limit.", "limit-weekly-sonnet-{band}"),
    "primary": ("{label} limit {band}%", "You've used {used}% of this Codex limit.", "codex-limit-primary-{band}"),
    "secondary": ("{label} limit {band}%", "You've used {used}% of this Codex limit.", "codex-limit-secondary-{band}"),
}


def alert_texts(alerts: DataFrame) -> DataFrame:
    """alerts(window, percent, band, label) with title, body and notice_id. The percent is cut to a whole one, not rounded."""
    fields = {"label": F.coalesce("label", F.lit("limit")), "band": F.col("band").cast("string"), "used": F.floor("percent").cast("string")}

    def filled(i: int) -> Column:
        out = F.lit(None).cast("string")
        for window, texts in ALERTS.items():
            text = F.lit(texts[i])
            for name, value in fields.items():
                text = F.replace(text, F.lit(f"{{{name}}}"), value)
            out = F.when(F.col("window") == window, text).otherwise(out)
        return out

    return alerts.withColumns({"title": filled(0), "body": filled(1), "notice_id": filled(2)})


#: Items of the menu bar and the gauge that each shows; periods not fixed come from the reading.
GAUGES = (("session", "claudeCode", "session", "5h"), ("weekly", "claudeCode", "weekly", "7d"), ("chatgptPrimary", "codex", "primary", None), ("chatgptSecondary", "codex", "secondary", None))


def menu_gauges(readings_: DataFrame, items: str) -> DataFrame:
    """(place, provider, period, percent) of the gauges chosen by a comma list of items, of readings(window, utilization, minutes); a
    row of provider tokens (place 9) stands for the token count: if it is chosen, or if no gauge has a reading."""
    chosen = [(i, p, w, t) for i, (name, p, w, t) in enumerate(GAUGES) if name in items.split(",")]
    spark = readings_.sparkSession
    wanted = spark.createDataFrame(chosen, "place int, provider string, window string, fixed string")
    shown = readings_.join(F.broadcast(wanted), "window").select("place", "provider", F.coalesce("fixed", window_label(F.col("minutes"))).alias("period"), F.floor(F.col("utilization") + 0.5).cast("long").alias("percent"))
    tokens = spark.range(1).select(F.lit(9).alias("place"), F.lit("tokens").alias("provider"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("long").alias("percent"))
    if "tokens" in items.split(","):
        return shown.unionByName(tokens)
    none = shown.agg(F.count("*").alias("n")).filter("n = 0")  # one row, or no row
    return shown.unionByName(tokens.join(F.broadcast(none)).drop("n"))
