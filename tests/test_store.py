"""The call store: any split into batches, compaction and retries between them, gives the strongest rows and their sums; trims and folds count once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from callmeter import sinks
from callmeter.operators import performance, retention, usage
from callmeter.operators.reconcile import strongest_per_key
from callmeter.sources import collect
from callmeter.streaming.store import Store
from callmeter.versions import Taken, Versions
from tests.test_rules import events

COLUMNS = ("dedup_key", "ts", "day", "status", "output_tokens", "provider")


def observations(spark, seed, n=60, keys=15):
    """Rows of few keys, of any strength, over four days; some without key, or time."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 95))
        rows.append({"dedup_key": rnd.choice([None, *[f"k{j}" for j in range(keys)]]), "ts": rnd.choice([ts, ts, ts, None]), "provider": rnd.choice(["codex", "ollama"]), "status": rnd.choice(["running", "succeeded"]), "token_accuracy": rnd.choice(["exact", "unknown"]), "output_tokens": rnd.randint(0, 3), "input_tokens": rnd.randint(0, 9), "arrival_seq": i})
    return events(spark, *rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def plain(rows):
    return sorted(map(repr, map(tuple, rows.collect())))


def best(observed):
    return strongest_per_key(observed).withColumn("day", F.to_date("ts"))


def folds(rows, period):
    return rows.groupBy(F.date_trunc(period, "ts").cast("timestamp_ntz"), "provider").agg(F.sum("input_tokens"), F.sum("output_tokens"), F.sum(F.col("cache_read") + F.col("cache_create")), F.sum("reasoning"), F.count("*"))


@pytest.mark.parametrize(("seed", "splits", "buckets"), [(2, 3, 64), (3, 5, 1)])
def test_any_split_gives_the_strongest_rows_and_their_sums(spark, tmp_path, seed, splits, buckets):
    observed, rnd = observations(spark, seed).cache(), random.Random(seed)
    store = Store(spark, str(tmp_path), buckets)
    run = store.upsert()
    for number in range(splits):
        batch = observed.filter(F.pmod(F.xxhash64("arrival_seq"), F.lit(splits)) == number)
        run(batch, number)
        if rnd.random() < 0.5:
            store.compact(folders=rnd.choice([1, 2]))
        run(batch, number)  # again: its number has been
    assert plain(store.rows().select(*COLUMNS)) == plain(best(observed).select(*COLUMNS))
    assert plain(store.hours()) == plain(folds(best(observed), "hour"))
    assert plain(store.days()) == plain(usage.day_fold(best(observed).withColumn("shadowed", F.lit(False))))
    kept = store.changes()
    assert plain(kept.groupBy("dedup_key", "ts", "provider", "output_tokens").agg(F.sum("sign").alias("n")).filter("n <> 0").select("dedup_key", "ts", "provider", "output_tokens", "n")) == plain(best(observed).groupBy("dedup_key", "ts", "provider", "output_tokens").count())


def test_batches_go_on_after_compaction(spark, tmp_path):
    """Numbers of batches are consecutive, and a compaction between them takes none."""
    store = Store(spark, str(tmp_path))
    for number in range(5):
        store.upsert()(events(spark, {"dedup_key": f"k{number}"}, {"dedup_key": "same", "output_tokens": number, "arrival_seq": number}), number)
        if number in (1, 3):
            store.compact(folders=1)
            store.versions.remove_unused()
    assert {(r.dedup_key, r.output_tokens) for r in store.rows().collect()} == {("same", 4), *((f"k{i}", 0) for i in range(5))}


def test_a_batch_reads_its_keys_buckets_alone(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), buckets=32)
    store.upsert()(events(spark, *[{"dedup_key": f"k{i}"} for i in range(400)]), 0)
    read, original = [], Versions.read
    monkeypatch.setattr(Versions, "read", lambda self, folders, schema: read.extend(folders) or original(self, folders, schema))
    store.upsert()(events(spark, {"dedup_key": "k7", "output_tokens": 8}, {"dedup_key": "new"}), 1)
    index = [f for f in read if "/keys/" in f]
    assert 1 <= len(index) <= 2 and not [f for f in read if "/rows/" in f]
    bucket = {r.dedup_key: r.b for r in spark.createDataFrame([("k7",), ("new",)], "dedup_key string").withColumn("b", F.pmod(F.xxhash64("dedup_key"), F.lit(32))).collect()}
    assert {int(f.rsplit("=", 1)[1]) for f in index} <= set(bucket.values())
    assert store.rows().filter("dedup_key = 'k7'").first().output_tokens == 8


def test_partial_then_final_counts_once(spark, tmp_path):
    store, at = Store(spark, str(tmp_path)), dt.datetime(2024, 1, 1, 10, 59)
    store.upsert()(events(spark, {"status": "running", "output_tokens": 5, "ts": at}), 0)
    store.upsert()(events(spark, {"output_tokens": 9, "ts": at + dt.timedelta(minutes=2)}), 1)
    assert [(r.hour.hour, r.output, r.calls) for r in store.hours().collect()] == [(11, 9, 1)]
    assert sorted((r.sign, r.output_tokens) for r in store.changes(0).collect()) == [(-1, 5), (1, 9)]


def test_streams_have_numbers_of_their_own(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for stream in ("a", "b", "a"):
        store.upsert(stream)(events(spark, {"dedup_key": stream, "output_tokens": 1}), 0)
    assert sorted(r.dedup_key for r in store.rows().collect()) == ["a", "b"] and store.versions.latest()["streams"] == {"a": 0, "b": 0}


def test_structured_stream(spark, tmp_path):
    observed, source = observations(spark, 5), str(tmp_path / "in")
    for part in range(3):
        observed.filter(F.col("arrival_seq") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # a second start finds nothing new
        reader = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).parquet(source)
        assert reader.writeStream.foreachBatch(store.upsert()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert plain(store.rows().select(*COLUMNS)) == plain(best(observed).select(*COLUMNS)) and store.versions.latest()["streams"]["events"] >= 1


def test_hidden_calls_leave_the_totals_and_stay_hidden(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert()(events(spark, {"status": "running", "output_tokens": 5}, {"dedup_key": "b", "output_tokens": 7}, {"dedup_key": "c", "shadowed": True}), 0)
    keys = spark.createDataFrame([("k0",), ("none",), (None,)], "dedup_key string")
    for _ in range(2):
        store.hide(keys)
    assert {(r.dedup_key, r.shadowed) for r in store.rows().collect()} == {("k0", True), ("b", False), ("c", True)}
    store.upsert()(events(spark, {"output_tokens": 6, "ts": dt.datetime(2024, 1, 9)}), 1)  # stronger, and of another day
    store.compact(folders=1)
    assert {(r.dedup_key, r.shadowed, r.output_tokens) for r in store.rows().collect()} == {("k0", True, 6), ("b", False, 7), ("c", True, 0)}
    assert [(r.output, r.calls) for r in store.hours().collect()] == [(7, 1)]


@pytest.mark.parametrize("cap", [None, 20])
def test_trim_counts_once(spark, tmp_path, cap):
    observed = observations(spark, 8, 90, 60).cache()
    store, as_of = Store(spark, str(tmp_path)), "2024-02-03 12:00:00"  # two days are frozen
    store.upsert()(observed, 0)
    stored = best(observed).withColumn("shadowed", F.lit(False)).cache()
    timed = stored.filter("ts is not null")
    live, history = retention.trim(timed, usage.day_fold(timed.limit(0)), as_of, cap)
    versions = []
    for _ in range(3):
        store.trim(as_of, cap)
        versions.append(store.versions.latest()["version"])
        assert plain(store.history()) == plain(history)
        assert plain(store.rows().filter("ts is not null").select(*COLUMNS)) == plain(live.select(*COLUMNS))
        assert plain(store.days().filter("day is not null")) == plain(usage.day_fold(live))
    assert versions[0] == versions[2]
    store.compact(folders=1)
    store.upsert()(observed, 1)  # all of it again: frozen calls do not come back
    assert plain(store.history()) == plain(history) and plain(store.days().filter("day is not null").filter("calls > 0")) == plain(usage.day_fold(live.unionByName(stored.filter("dedup_key is null and ts >= date '2024-01-03'"))))


def test_late_rows_once_up_to_the_watermark(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    store = Store(spark, str(tmp_path))
    store.upsert()(events(spark, {"ts": at(1), "input_tokens": 1}, {"ts": at(20), "input_tokens": 4}), 0)
    store.trim("2024-02-14")
    late = events(spark, {"ts": at(2), "input_tokens": 8}, {"ts": at(5), "input_tokens": 16}, {"ts": at(25), "input_tokens": 32}).withColumn("collector", F.lit("c"))
    for number in (0, 0):
        store.late(late, "late", number, {"c": "2024-01-04 00:00:00"})
    assert sorted(r.input for r in store.history().collect()) == [1, 8, 16] and store.watermarks() == {"c": "2024-01-04 00:00:00"}
    store.late(late, "late", 1, {"c": "2024-01-03 00:00:00"})  # the second is covered now; a watermark never goes back
    assert sorted(r.input for r in store.history().collect()) == [1, 8, 32] and store.watermarks() == {"c": "2024-01-04 00:00:00"}


def test_a_write_that_is_cut_off_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.upsert()(events(spark, {"output_tokens": 1}), 0)
    before, hours = plain(store.rows()), plain(store.hours())
    monkeypatch.setattr(Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    for change in (lambda: store.upsert()(events(spark, {"output_tokens": 2}), 1), lambda: store.trim("2024-06-01"), lambda: store.compact(folders=1)):
        with pytest.raises(RuntimeError):
            change()
    monkeypatch.undo()
    assert plain(store.rows()) == before and plain(store.hours()) == hours
    store.upsert()(events(spark, {"output_tokens": 2}), 1)
    store.versions.remove_unused()
    assert [r.output_tokens for r in store.rows().collect()] == [2]


def test_of_two_writers_one_starts_again(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert()(events(spark, {}), 0)
    state = store.versions.latest()
    store.upsert()(events(spark, {"dedup_key": "b"}), 1)
    with pytest.raises(Taken):
        store.versions.commit(state)
    assert store.rows().count() == 2


def test_history_and_journal_are_rewritten_in_their_place(spark, tmp_path, monkeypatch):
    folder, journal = str(tmp_path / "history"), str(tmp_path / "journal")
    rows = events(spark, {"ts": dt.datetime(2024, 1, 1), "input_tokens": 3}, {"ts": dt.datetime(2024, 1, 2), "input_tokens": 4}, {"dedup_key": "k0", "ts": dt.datetime(2024, 1, 1), "output_tokens": 9, "arrival_seq": 5})
    marks = retention.advance(spark.createDataFrame([], retention.WATERMARK), "c", F.lit("2024-01-03"))
    sinks.write_history(usage.day_fold(rows.limit(2)), marks, folder)
    for n in (2, 3):
        days, marks = sinks.load_history(spark, folder)
        sinks.write_history(usage.merge_history(days, usage.day_fold(rows.limit(1))), retention.advance(marks, "d", F.lit(f"2024-01-0{n}")), folder)
    days, marks = sinks.load_history(spark, folder)
    assert sorted((r.day.day, r.input) for r in days.collect()) == [(1, 9), (2, 4)]
    assert sorted((r.collector, r.complete_through.day) for r in marks.collect()) == [("c", 3), ("d", 3)]
    before = plain(days)
    monkeypatch.setattr(Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        sinks.write_history(usage.day_fold(rows), marks, folder)
    monkeypatch.undo()
    assert plain(sinks.load_history(spark, folder)[0]) == before
    sinks.append_journal(collect.as_usage_events(rows.limit(2)), journal)
    for _ in range(2):
        sinks.append_journal(collect.as_usage_events(rows), journal)
        sinks.compact_journal(spark, journal)
        assert sorted((r.dedup_key, r.output_tokens) for r in sinks.load_journal(spark, journal, "2024-01-03 00:00:00").collect()) == [("k0", 9), ("k1", 0)]
    assert sinks.load_journal(spark, str(tmp_path / "none"), "2024-01-03 00:00:00").count() == 0


def test_cap_keeps_rows_without_key_and_ties(spark):
    at = lambda h: dt.datetime(2024, 2, 1, h)
    rows = events(spark, {"dedup_key": None, "ts": at(3)}, {"dedup_key": "a", "ts": at(1)}, {"dedup_key": "b", "ts": at(2)})
    left = lambda cap: sorted(repr(r.dedup_key) for r in retention.leaving(rows, "2024-02-14", cap).collect())
    assert [left(n) for n in (3, 2, 1, 0)] == [[], ["'a'"], ["'a'", "'b'"], ["'a'", "'b'", "None"]]
    tied = events(spark, *[{"dedup_key": f"t{i}", "ts": at(1), "arrival_seq": 1} for i in range(3)])
    assert retention.leaving(tied, "2024-02-14", 2).count() == 0


def test_medians_of_stored_days_are_those_of_the_rows(spark, tmp_path):
    rnd, folder = random.Random(4), str(tmp_path)
    rows = events(spark, *[{"ts": dt.datetime(2024, 1, rnd.randint(1, 5), 3), "model": rnd.choice(["a", "b", None]), "tps": rnd.choice([None, 0.0, rnd.gauss(3, 2), 2.5]), "duration_s": rnd.random(), "status": rnd.choice(["failed", "succeeded"]), "shadowed": rnd.random() < 0.1} for _ in range(150)])
    for part in (rows.filter("ts < date'2024-01-03'"), rows.filter("ts >= date'2024-01-03'"), rows.filter("to_date(ts) = date'2024-01-04'")):
        sinks.write_day_values(part, folder)
    held = sinks.load_day_values(spark, folder, "2024-01-02", "2024-01-04")
    assert len(held.inputFiles()) == len([f for f in held.inputFiles() if "2024-01-0" in f and "=2024-01-01" not in f and "=2024-01-05" not in f]) > 0
    assert plain(performance.of_values(held)) == plain(performance.by_model(rows.filter("ts >= date'2024-01-02' and ts < date'2024-01-05'")))


def test_a_file_that_lags_holds_its_collector_back(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    read = spark.createDataFrame([("a1", at(9)), ("a2", at(4)), ("a2", at(3)), ("b1", at(7)), ("c1", at(1))], "path string, ts timestamp")
    files = lambda lag: spark.createDataFrame([("a", "a1", 5, 5), ("a", "a2", lag, 5), ("b", "b1", 5, 5), ("c", "c1", 5, 5), ("c", "c2", 0, 5)], "collector string, path string, consumed long, size long")
    told = lambda lag: {r.collector: r.complete_through and r.complete_through.day for r in retention.frontier(files(lag), read).collect()}
    assert told(4) == {"a": 4, "b": 7, "c": None} and told(5) == {"a": 9, "b": 7, "c": None}
    store = Store(spark, str(tmp_path))
    store.upsert()(events(spark, {"ts": at(1)}), 0)
    store.trim("2024-02-20")
    for number, lag in enumerate((4, 5)):  # the late row of the 6th is folded while its collector is not complete, and refused after
        through = {r.collector: str(r.complete_through) for r in retention.frontier(files(lag), read).collect() if r.complete_through}
        store.late(events(spark, {"dedup_key": f"late{number}", "ts": at(6), "input_tokens": 5}).withColumn("collector", F.lit("a")), "late", number, through)
    store.late(events(spark, {"dedup_key": "late2", "ts": at(6), "input_tokens": 9}).withColumn("collector", F.lit("a")), "late", 2, {})
    assert sorted(r.input for r in store.history().collect()) == [0, 10]
