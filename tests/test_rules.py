"""Rules on hand-made rows."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from callmeter.functions import format as fmt
from callmeter.operators import limits, ordered, performance, reconcile, retention, status, usage
from callmeter.streaming import upsert

BASE = {"dedup_key": "k", "ts": dt.datetime(2024, 1, 1, 12), "started_at": None, "provider": "ollama", "source": "proxy", "model": "m", "session_id": "s", "project": None, "input_tokens": 0, "output_tokens": 0, "cache_read": 0, "cache_create": 0, "reasoning": 0, "token_accuracy": "exact", "status": "succeeded", "duration_s": None, "load_s": None, "ttft_s": None, "tps": None, "shadowed": False, "arrival_seq": 0}
SCHEMA = "dedup_key string, ts timestamp_ntz, started_at timestamp_ntz, provider string, source string, model string, session_id string, project string, input_tokens long, output_tokens long, cache_read long, cache_create long, reasoning long, token_accuracy string, status string, duration_s double, load_s double, ttft_s double, tps double, shadowed boolean, arrival_seq long"


def events(spark, *rows):
    return spark.createDataFrame([tuple({**BASE, "dedup_key": f"k{i}", "arrival_seq": i, **r}.values()) for i, r in enumerate(rows)], SCHEMA)


def test_unmetered_and_totals(spark):
    (t,) = usage.totals(events(spark, {"token_accuracy": "unknown"}, {"input_tokens": 10, "output_tokens": 5}, {}), "month", "2024-01-01 23:00:00").collect()
    assert (t.calls, t.unmetered, t.input_tokens) == (3, 1, 10)


def test_week_has_no_upper_bound_but_charts_do(spark):
    e = events(spark, {"input_tokens": 1}, {"input_tokens": 2, "ts": dt.datetime(2024, 1, 5)})
    assert usage.totals(e, "week", "2024-01-01 13:00:00").first().input_tokens == 3
    assert usage.daily(e, "week", "2024-01-01 13:00:00", True).agg(F.sum("ollama")).first()[0] == 1


def test_medians(spark):
    e = events(spark, {"tps": 7.5, "ttft_s": 1.5, "duration_s": 9.0, "status": "failed"}, {"tps": 12.5, "ttft_s": 2.5, "duration_s": 1.0, "token_accuracy": "estimated"}, {"tps": 99.0, "shadowed": True})
    (r,) = performance.by_provider(e).collect()
    assert (r.calls, r.failed, r.estimated, r.median_tps, round(r.median_ttft_s, 6), r.median_duration_s) == (2, 1, 1, 10.0, 2.0, 5.0)


def test_overlap_of_desktop_and_proxy(spark):
    t = dt.datetime(2024, 1, 1, 12)
    s = lambda n: t + dt.timedelta(seconds=n)
    desk = {"source": "ollamaDesktop", "ts": s(1)}
    cases = [({"model": ""}, True), ({"model": "z"}, False), ({"started_at": s(12 - 60)}, True), ({"started_at": s(-12 - 60)}, False), ({"ts": s(4)}, False), ({"ts": s(-3)}, True)]
    for change, want in cases:
        e = events(spark, {"started_at": s(-60)}, {**desk, **change})
        assert (reconcile.shadowed_desktop(e).count() == 1) == want, change


def test_reingest_changes_nothing(spark):
    e = events(spark, {"output_tokens": 5}, {"output_tokens": 9, "dedup_key": "k0"}, {"output_tokens": 9, "dedup_key": "k0", "model": "later"})
    once = sorted(map(tuple, reconcile.strongest_per_key(e).collect()))
    assert sorted(map(tuple, reconcile.strongest_per_key(e.unionByName(e)).collect())) == once and once[0][5] == "m"


def test_rail(spark):
    w = spark.createDataFrame([("claude-secondary", 85.0, 10080), ("codex-primary", 60.0, 300), ("claude-primary", 85.1, 300), ("claude-sonnet", 99.0, 1)], "id string, utilization double, minutes long")
    assert [r.id for r in limits.rail(w).orderBy("place").collect()] == ["codex-primary", "claude-primary", "claude-secondary"]
    assert limits.nearest(w).first().id == "claude-primary"
    assert [r.s for r in spark.createDataFrame([(x,) for x in (59.9, 60.0, 85.0, 85.1)], "u double").select(fmt.severity(F.col("u")).alias("s")).collect()] == ["healthy", "warning", "warning", "danger"]


def test_alerts_rearm(spark):
    p = [10, 30, 40, 80, 60, 76, 20, 26]
    h = spark.createDataFrame([("a", "primary", dt.datetime(2024, 1, 1, i), float(x)) for i, x in enumerate(p)], "account string, window string, ts timestamp, percent double")
    assert [r.band for r in limits.threshold_alerts(h).orderBy("ts").collect()] == [25, 75, 75, 25]


def test_labels(spark):
    n = spark.createDataFrame([(x,) for x in (999, 1250, 99_949, 100_000, 999_999, 1_250_000)], "n long").select(fmt.compact(F.col("n")).alias("s")).collect()
    assert [r.s for r in n] == ["999", "1.3k", "99.9k", "100k", "1000k", "1.25M"]
    lab = spark.createDataFrame([("FFFFFF",)], "h string").select(*[c.alias(n) for c, n in zip(fmt.oklab(fmt.hex_rgb(F.col("h"))), "Lab", strict=True)]).first()
    assert abs(lab.L - 1) < 1e-3 and abs(lab.a) < 1e-3


def test_status_gate(spark):
    s = spark.createDataFrame([("x", dt.datetime(2024, 1, 1, i), v, i) for i, v in enumerate(["up", "up", "down", "down", "up"])], "service string, ts timestamp, state string, beat long")
    assert [r.state for r in status.significant(s, "service", ["state"]).orderBy("ts").collect()] == ["up", "down", "up"]


def test_upsert_twice(spark, tmp_path):
    day1 = events(spark, {"output_tokens": 5}, {"output_tokens": 1})
    day2 = events(spark, {"output_tokens": 7}, {"dedup_key": "new", "ts": dt.datetime(2024, 1, 2)})
    run = upsert.upsert_days(spark, str(tmp_path / "silver"))
    for epoch, batch in ((0, day1), (1, day2), (1, day2)):
        run(batch, epoch)
    got = {r.dedup_key: r.output_tokens for r in upsert.latest_days(spark, str(tmp_path / "silver")).collect()}
    assert got == {"k0": 7, "k1": 1, "new": 0}


def test_live_calls(spark, tmp_path):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    schema = "call_id string, ts timestamp, output_tokens long, status string"
    src = tmp_path / "in"
    for i, rows in enumerate([[("a", at(0), 5, "running"), ("b", at(0), 1, "running")], [("a", at(10), 3, "running"), ("b", at(12), 9, "succeeded")], [("c", at(1000), 1, "running")], [("c", at(1001), 2, "running")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = upsert.live_calls(spark.readStream.schema(schema).parquet(str(src)).withWatermark("ts", "0 seconds")).writeStream.outputMode("update").foreachBatch(lambda df, e: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert i >= 0
    got = {(r.call_id, r.status, r.output_tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("b", "succeeded", 9), ("a", "stale", 5), ("c", "running", 2)} <= got


def test_medians_by_brute_force(spark):
    rng = random.Random(3)
    rows = [{"model": rng.choice("abc"), "tps": rng.choice([None, 0.0, -1.5, rng.gauss(5, 3), 5.0]), "ttft_s": rng.random() * 10 ** rng.randint(-6, 6)} for _ in range(400)] + [{"model": "d"}]
    found = {r.model: r for r in performance.by_model(events(spark, *rows)).collect()}
    for model in "abcd":
        for c in ("tps", "ttft_s"):
            values = [r[c] for r in rows if r["model"] == model and r.get(c) is not None]
            got = found[model][f"median_{c}"]
            assert got == pytest.approx(statistics.median(values)) if values else got is None


def test_reconcile_reads_what_it_wrote(spark):
    rows = [{"output_tokens": 9, "source": s, "ts": dt.datetime(2024, 1, 1, 12, 0, i)} for i, s in enumerate(("transcript", "proxy", "ollamaDesktop", "proxy"))] + [{"output_tokens": 80, "dedup_key": None}]
    found = reconcile.reconcile(events(spark, *rows))
    assert sorted((repr(r.dedup_key), r.shadowed) for r in found.collect()) == [("'k0'", False), ("'k1'", True), ("'k2'", False), ("'k3'", True), ("None", False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3 and "Window" not in plan  # the written rows and the written keys


def stored(spark, folder):
    return sorted((r.dedup_key, str(r.day), r.output_tokens) for r in upsert.latest_days(spark, folder).collect())


def test_upsert_across_midnight(spark, tmp_path):
    folder = str(tmp_path / "silver")
    run = upsert.upsert_days(spark, folder)
    first = events(spark, {"status": "running", "output_tokens": 1, "ts": dt.datetime(2024, 1, 1, 23, 59)}, {"ts": dt.datetime(2024, 1, 3), "output_tokens": 4})
    last = events(spark, {"output_tokens": 5, "ts": dt.datetime(2024, 1, 2, 0, 1)})
    run(first, 0)
    for _ in range(2):
        run(last, 1)
        assert stored(spark, folder) == [("k0", "2024-01-02", 5), ("k1", "2024-01-03", 4)]  # the first day is empty now
    run(events(spark, {"status": "running", "output_tokens": 9, "ts": dt.datetime(2024, 1, 5)}), 2)
    assert stored(spark, folder) == [("k0", "2024-01-02", 5), ("k1", "2024-01-03", 4)]  # a weaker row of another day changes nothing
    upsert.compact(spark, folder, 3)
    assert stored(spark, folder) == [("k0", "2024-01-02", 5), ("k1", "2024-01-03", 4)] and set(upsert.newest_epochs(spark, folder).values()) == {3}


def test_ties_go_by_arrival(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("x", t, 2, "down"), ("x", t, 1, "up"), ("x", t, 3, "up"), ("x", dt.datetime(2024, 1, 4), 4, "up"), ("x", dt.datetime(2024, 1, 5), 5, "down")]
    h = spark.createDataFrame(rows, "service string, ts timestamp, arrival_seq long, indicator string")
    assert sorted((r.arrival_seq, r.before) for r in status.changes(h).collect()) == [(2, "up"), (3, "down"), (5, "up")]


def test_values_are_carried_over_blocks(spark):
    rng = random.Random(1)
    rows = [("abN"[i % 3].replace("N", "") or None, i, rng.choice([None, None, None, f"v{i}"])) for i in range(200)]
    d = spark.createDataFrame(rows, "k string, at long, v string")
    got = {r.at: (r.last, r.before) for r in ordered.previous(ordered.carried(d, ["k"], F.floor(F.col("at") / 17), ["at"], F.col("v"), "last"), ["k"], F.floor(F.col("at") / 17), ["at"], F.col("at"), "before").collect()}
    seen, prior = {}, {}
    for k, at, v in rows:
        seen[k] = v or seen.get(k)
        assert got[at] == (seen[k], prior.get(k))
        prior[k] = at


def test_late_rows_and_watermarks(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    e = events(spark, {"ts": at(1), "input_tokens": 1}, {"ts": at(5), "input_tokens": 2}, {"ts": at(20), "input_tokens": 4})
    marks = retention.advance(spark.createDataFrame([], retention.WATERMARK), "c", F.lit("2024-01-03"))
    marks = retention.advance(marks, "c", F.lit("2024-01-02"))
    days = retention.apply_late(usage.day_fold(e.limit(0)), marks, e.withColumn("collector", F.lit("c")), "2024-02-14")
    assert [r.input for r in days.collect()] == [2]  # the first is covered, the last is live
    assert [r.input_tokens for r in retention.backfill(e, None, "2024-02-14").orderBy("ts").collect()] == [1, 2]
