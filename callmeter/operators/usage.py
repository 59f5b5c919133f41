"""Token totals by provider, model, session, project and time. Every function takes usage events and an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.format import compact, heat_opacity
from ..schema import PERIOD_DAYS, PROVIDERS


def visible(events: DataFrame) -> DataFrame:
    """Events that no other observation shadows."""
    return events.filter(~F.coalesce("shadowed", F.lit(False)))


def in_period(events: DataFrame, period: str, as_of: str) -> DataFrame:
    """today: the local day of as_of; week and month: from the start of the day days - 1 before, with no upper bound."""
    day = F.to_date(F.lit(as_of))
    if period == "today":
        return visible(events).filter((F.col("ts") >= day) & (F.col("ts") < F.date_add(day, 1)))
    return visible(events).filter(F.col("ts") >= F.date_sub(day, PERIOD_DAYS[period] - 1))


def unmetered() -> Column:
    """Unknown is not zero: calls of unknown accuracy without tokens."""
    return (F.col("token_accuracy") == "unknown") & (F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read") + F.col("cache_create") == 0)


def _totals() -> list[Column]:
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_create", "reasoning")]
    return [*sums, F.count("*").alias("calls"), F.count_if(unmetered()).alias("unmetered")]


def totals(events: DataFrame, period: str, as_of: str, *by: str) -> DataFrame:
    return in_period(events, period, as_of).groupBy(*by).agg(*_totals())


def top_models(events: DataFrame, period: str, as_of: str, n: int = 5) -> DataFrame:
    """The n models of each provider with most fresh tokens, and how many models remain."""
    by = totals(events, period, as_of, "provider", "model").withColumn("fresh", F.col("input_tokens") + F.col("output_tokens"))
    ranked = by.withColumn("rank", F.row_number().over(W.partitionBy("provider").orderBy(F.desc("fresh"), "model"))).withColumn("models", F.count("*").over(W.partitionBy("provider")))
    return ranked.filter(F.col("rank") <= n).select("provider", "model", "fresh", "calls", "rank", F.greatest(F.col("models") - n, F.lit(0)).cast("long").alias("more"))


def sessions(events: DataFrame, period: str, as_of: str) -> DataFrame:
    """One row for each provider and session (activity without one); project and title fields of its first row by time."""
    rows = in_period(events, period, as_of).withColumn("session", F.coalesce("session_id", F.lit("activity")))
    order = F.struct("ts", "arrival_seq")
    first = F.min_by(F.struct("source", "model", F.when(F.col("source") != "proxy", F.col("project")).alias("project")), order)
    out = rows.groupBy("provider", "session").agg(*_totals(), F.max("ts").alias("last_activity"), F.sort_array(F.collect_set("model")).alias("models"), first.alias("first"))
    age = F.expr(f"timestampdiff(SECOND, last_activity, timestamp_ntz'{as_of}')")
    return out.select("provider", "session", F.col("first.source").alias("first_source"), F.col("first.model").alias("first_model"), F.col("first.project").alias("project"), *[c for c in out.columns if c not in ("provider", "session", "first", "models")], F.size("models").cast("long").alias("n_models"), F.array_join("models", ",").alias("models"), (age < 900).alias("is_active"))


def session_titles(found: DataFrame, names: DataFrame) -> DataFrame:
    """Titles of sessions(): by source, then a stored name, then what the provider's rows tell. names(session, name)."""
    short = F.substring("session", 1, 8)
    title = (
        F.when(F.col("first_source") == "proxy", "Ollama (direct)").when(F.col("first_source") == "ollamaDesktop", "Ollama Desktop").when(F.col("name").isNotNull(), F.col("name"))
        .when(F.col("provider") == "lmStudio", F.concat(F.lit("LM Studio · "), "first_model")).when((F.col("provider") == "codex") & F.col("project").isNotNull(), F.concat(F.lit("Codex · "), "project"))
        .when(F.col("provider") == "codex", F.concat(F.lit("Codex session "), short)).otherwise(F.concat(F.lit("Session "), short))
    )
    return found.join(names, "session", "left").withColumn("title", title).drop("name")


def chart_tokens(include_cache: bool) -> Column:
    fresh = F.col("input_tokens") + F.col("output_tokens")
    return fresh + F.col("cache_read") + F.col("cache_create") if include_cache else fresh


def _by_provider(tokens: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("provider") == p, tokens)), F.lit(0)).cast("long").alias(p) for p in PROVIDERS]


def _calendar(events: DataFrame, first: Column, days: int) -> DataFrame:
    return events.sparkSession.range(days).select(F.date_add(first, F.col("id").cast("int")).alias("day"))


def _dense(slots: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    return slots.join(F.broadcast(sums), key, "left").select(key, *[F.coalesce(p, F.lit(0)).cast("long").alias(p) for p in PROVIDERS])  # sums has a row for each slot


def daily(events: DataFrame, period: str, as_of: str, include_cache: bool, weekends: bool = True) -> DataFrame:
    """Exactly the period's days up to as_of's, each with a column for each provider. Weekends can be left out of periods over a day."""
    n = PERIOD_DAYS[period]
    first = F.date_sub(F.to_date(F.lit(as_of)), n - 1)
    sums = in_period(events, period, as_of).filter(F.col("ts") < F.date_add(F.to_date(F.lit(as_of)), 1)).groupBy(F.to_date("ts").alias("day")).agg(*_by_provider(chart_tokens(include_cache)))
    out = _dense(_calendar(events, first, n), sums, "day")
    return out if weekends or n == 1 else out.filter(~F.dayofweek("day").isin(1, 7))


def hourly(events: DataFrame, as_of: str, include_cache: bool) -> DataFrame:
    """24 slots of today by elapsed hours."""
    slot = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{as_of[:10]} 00:00:00', ts) div 3600").cast("long")
    sums = in_period(events, "today", as_of).withColumn("hour", slot).filter(F.col("hour").between(0, 23)).groupBy("hour").agg(*_by_provider(chart_tokens(include_cache)))
    return _dense(events.sparkSession.range(24).select(F.col("id").alias("hour")), sums, "hour")


def day_fold(events: DataFrame) -> DataFrame:
    """(day, provider) aggregates of visible events: what history keeps."""
    cache = F.col("cache_read") + F.col("cache_create")
    return visible(events).groupBy(F.to_date("ts").alias("day"), "provider").agg(F.sum("input_tokens").alias("input"), F.sum("output_tokens").alias("output"), F.sum(cache).alias("cache"), F.sum("reasoning").alias("reasoning"), F.count("*").alias("calls"))


def merge_history(*parts: DataFrame) -> DataFrame:
    """Sums partial day aggregates."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("day", "provider").agg(*[F.sum(c).cast("long").alias(c) for c in ("input", "output", "cache", "reasoning", "calls")])


def heatmap(live: DataFrame, frozen: DataFrame, as_of: str, weeks: int = 26, include_cache: bool = True) -> DataFrame:
    """weeks * 7 days from the Sunday weeks - 1 before as_of's week; live events and frozen day aggregates are added."""
    today = F.to_date(F.lit(as_of))
    first = F.date_sub(today, F.dayofweek(today) - 1 + 7 * (weeks - 1))
    tokens = F.col("input") + F.col("output") + (F.col("cache") if include_cache else F.lit(0))
    live, frozen = live.filter(F.col("ts") >= first), frozen.filter(F.col("day") >= first)  # before the fold, so that it reaches the scan
    sums = merge_history(day_fold(live), frozen).groupBy("day").agg(*_by_provider(tokens))
    total = sum((F.col(p) for p in PROVIDERS[1:]), F.col(PROVIDERS[0]))
    out = _dense(_calendar(live, first, weeks * 7), sums, "day").withColumn("total", total)
    most = out.agg(F.greatest(F.max("total"), F.lit(1)).alias("most"))
    return out.crossJoin(F.broadcast(most)).withColumn("opacity", heat_opacity(F.col("total"), F.col("most"))).drop("most")  # most is one row


def month_labels(grid: DataFrame) -> DataFrame:
    """(column, label): the first week column and every change of month; the first goes if the second is within 2 columns."""
    w = W.orderBy("column")  # at most one row for each week of the grid
    weeks = grid.groupBy(F.floor(F.datediff("day", F.lit("1970-01-04").cast("date")) / 7).cast("long").alias("week")).agg(F.min("day").alias("day"))
    cols = weeks.withColumn("column", F.col("week") - F.min("week").over(W.partitionBy(F.lit(0)))).withColumn("month", F.month("day"))
    marks = cols.withColumn("before", F.lag("month").over(w)).filter("before is null or before <> month").withColumn("next", F.lead("column").over(w))
    return marks.filter(~((F.col("column") == 0) & (F.col("next") <= 2))).select("column", F.date_format("day", "MMM").alias("label"))


def top_project(events: DataFrame, period: str, as_of: str) -> DataFrame:
    by = in_period(events, period, as_of).filter("project is not null and project <> ''").groupBy("project").agg(F.sum(chart_tokens(True)).cast("long").alias("tokens"))
    return by.orderBy(F.desc("tokens"), "project").limit(1)


def peak(slots: DataFrame, key: str) -> DataFrame:
    """The slot with most tokens, the earliest on ties."""
    total = sum((F.col(p) for p in PROVIDERS[1:]), F.col(PROVIDERS[0]))
    return slots.select(key, total.alias("tokens")).orderBy(F.desc("tokens"), key).limit(1)


def chart_maxima(slots: DataFrame) -> DataFrame:
    total = sum((F.col(p) for p in PROVIDERS[1:]), F.col(PROVIDERS[0]))
    return slots.agg(F.greatest(F.max(F.greatest(*PROVIDERS)), F.lit(1)).cast("long").alias("grouped"), F.greatest(F.max(total), F.lit(1)).cast("long").alias("stacked"))


def latest_calls(events: DataFrame, n: int = 8) -> DataFrame:
    return visible(events).orderBy(F.desc("ts"), F.desc("arrival_seq")).select("dedup_key", "ts", "provider", "model", "input_tokens", "output_tokens", "status").limit(n)


def kernel_trend(slots: DataFrame, key: str, samples: int = 64) -> DataFrame:
    """Gaussian kernel regression over the slots' totals: (s, x, y) at samples + 1 points; none under 3 slots.
    Slots are the days or hours of one chart, so the pairing is bounded by the chart."""
    total = sum((F.col(p) for p in PROVIDERS[1:]), F.col(PROVIDERS[0]))
    points = slots.select((F.row_number().over(W.orderBy(key)) - 1).cast("double").alias("i"), total.cast("double").alias("v"))
    n = points.agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("n >= 3")
    at = slots.sparkSession.range(samples + 1).crossJoin(F.broadcast(n)).withColumn("x", F.col("id") / samples * (F.col("n") - 1))
    u = (F.col("x") - F.col("i")) / F.greatest(F.lit(1.25), F.col("n") / 6.0)
    pairs = at.crossJoin(F.broadcast(points)).withColumn("w", F.exp(-0.5 * u * u))
    y = F.sum(F.col("w") * F.col("v")) / F.sum("w")
    return pairs.groupBy("id", "x", "top").agg(y.alias("y")).select(F.col("id").alias("s"), F.round("x", 6).alias("x"), F.round(F.greatest(F.lit(0.0), F.least(F.greatest("top", F.lit(1.0)), "y")), 3).alias("y"))


def headline(events: DataFrame, period: str, as_of: str, include_cache: bool) -> DataFrame:
    """(fresh, cached, headline) of a period: the headline counts cached tokens only if it is asked to."""
    all_ = totals(events, period, as_of)
    fresh, cached = F.col("input_tokens") + F.col("output_tokens"), F.col("cache_read") + F.col("cache_create")
    return all_.select(fresh.alias("fresh"), cached.alias("cached"), (fresh + cached if include_cache else fresh).alias("headline"))


def title_split(events: DataFrame, as_of: str) -> DataFrame:
    """(provider, tokens): today's fresh tokens of each provider that has calls."""
    return totals(events, "today", as_of, "provider").filter("calls > 0").select("provider", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))


def of_provider(found: DataFrame, provider: str | None) -> DataFrame:
    """sessions() of one provider; all of them without one."""
    return found if provider is None else found.filter(F.col("provider") == provider)


def past_slots(slots: DataFrame, key: str, as_of: str) -> DataFrame:
    """Slots that have begun: a trend is drawn over these, and later ones stay blank."""
    return slots.filter(F.col(key) <= (F.hour(F.lit(as_of).cast("timestamp_ntz")) if key == "hour" else F.to_date(F.lit(as_of))))


def day_columns(days: DataFrame) -> DataFrame:
    """History by day: for each provider its fresh tokens and those with cache, then both totals and the calls."""
    fresh, cached = F.col("input") + F.col("output"), F.col("input") + F.col("output") + F.col("cache")
    each = [F.coalesce(F.sum(F.when(F.col("provider") == p, v)), F.lit(0)).cast("long").alias(p + suffix) for p in PROVIDERS for v, suffix in ((fresh, ""), (cached, "_with_cache"))]
    return days.groupBy("day").agg(*each, F.sum(fresh).cast("long").alias("total"), F.sum(cached).cast("long").alias("total_with_cache"), F.sum("calls").cast("long").alias("calls"))


def menu_title(live: DataFrame, events: DataFrame, as_of: str, seconds: int = 8) -> DataFrame:
    """(title): the output of the newest live call (live(call_id, started_at, ts, output_tokens)) if its update is under `seconds` old; else
    today's fresh tokens."""
    newest = live.agg(F.max_by(F.struct("ts", "output_tokens"), F.struct("started_at", "call_id")).alias("call"))
    age = F.expr(f"timestampdiff(MICROSECOND, call.ts, timestamp_ntz'{as_of}')")
    both = headline(events, "today", as_of, False).crossJoin(F.broadcast(newest))  # one row each
    return both.select(F.when(age < seconds * 1_000_000, F.concat(F.lit("↓"), compact(F.col("call.output_tokens")))).otherwise(compact(F.col("fresh"))).alias("title"))
