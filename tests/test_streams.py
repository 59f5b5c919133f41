"""Streams against their batch forms: shadows on arrival, alerts and changes with memory, over several splits and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from callmeter.operators import arrival, limits, reconcile, status
from callmeter.streaming import alerts, shadows
from callmeter.streaming.store import Store
from tests.test_rules import events

T0 = dt.datetime(2024, 1, 1)


def steps(spark, folder, batches, start):
    """Each batch written to the input, then the stream started anew from its checkpoint; the progress of each start."""
    told = []
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = start(spark.readStream.schema(batch.schema).parquet(f"{folder}/in")).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        assert query.awaitTermination(240)
        told.append(query.recentProgress)
    return told


def calls(spark, seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["transcript", "transcript", "proxy", "proxy", "ollamaDesktop"])
        rows.append({"dedup_key": f"k{i}", "ts": T0 + dt.timedelta(seconds=i * 12 + rnd.randint(0, 40)), "provider": "ollama", "source": source, "model": rnd.choice(["m", "m", "n", ""]), "output_tokens": rnd.randint(0, 6), "token_accuracy": rnd.choice(["exact", "exact", "unknown"]), "arrival_seq": i})
    return events(spark, *rows)


@pytest.mark.parametrize(("seed", "splits"), [(4, 3)])
def test_shadows_on_arrival(spark, tmp_path, seed, splits):
    every = calls(spark, seed, 120).cache()
    size = -(-120 // splits)
    batches = [every.filter(F.floor(F.col("arrival_seq") / size) == i) for i in range(splits)]
    stored, hidden = every.limit(0), set()
    mark = lambda rows: rows.withColumn("shadowed", F.col("dedup_key").isin(*hidden) if hidden else F.lit(False))
    for batch in batches:
        for rule in (arrival.shadowed_by_arrival, arrival.desktop_by_arrival):
            hidden |= {r.dedup_key for r in rule(mark(stored), mark(batch)).collect()}
        stored = stored.unionByName(batch)
    assert hidden
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    progress = steps(spark, str(tmp_path / "pairs"), batches, lambda s: shadows.pairs(s, "2 minutes").writeStream.foreachBatch(shadows.hide(store)))
    store.upsert()(every, 0)  # the calls come after what explains them: the store remembers
    assert {r.dedup_key for r in store.rows().filter("shadowed").collect()} == hidden
    held = [sum(s["numRowsTotal"] for s in p.stateOperators) for told in progress for p in told]
    assert held[-1] < sum(s["numRowsUpdated"] for told in progress for p in told for s in p.stateOperators)  # rows go as time passes
    assert store.days().agg(F.sum("calls")).first()[0] == 120 - len(hidden)


def test_the_latest_of_two_proxies_is_shadowed(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    base = {"provider": "ollama", "output_tokens": 5, "token_accuracy": "exact"}
    first = events(spark, {**base, "dedup_key": "early", "source": "proxy", "ts": at(0)}, {**base, "dedup_key": "late", "source": "proxy", "ts": at(30)})
    second = events(spark, {**base, "dedup_key": "t", "source": "transcript", "ts": at(40)})
    third = events(spark, {**base, "dedup_key": "u", "source": "transcript", "ts": at(41)})
    store = Store(spark, str(tmp_path / "store"), buckets=2)
    for n, batch in enumerate((first, second, third)):
        store.upsert()(batch, n)
    steps(spark, str(tmp_path / "pairs"), [first, second, third], lambda s: shadows.pairs(s).writeStream.foreachBatch(shadows.hide(store)))
    assert {r.dedup_key: r.shadowed for r in store.rows().collect()} == {"early": True, "late": True, "t": False, "u": False}
    assert reconcile.shadowed_proxies(first.unionByName(second)).count() == 2  # a replay over all finds both at once


def readings(spark, seed, n=90):
    rnd = random.Random(seed)
    rows = [(rnd.choice("ab"), rnd.choice(["session", "weekly"]), T0 + dt.timedelta(minutes=3 * i + rnd.randint(-5, 5)), i, float(rnd.randint(0, 100)), rnd.choice(["none", "minor", "major"])) for i in range(n)]
    return spark.createDataFrame(rows, "account string, window string, ts timestamp, arrival_seq long, percent double, indicator string")


@pytest.mark.parametrize("splits", [3])
def test_alerts_and_changes_with_memory(spark, tmp_path, splits):
    """Rows up to ten minutes late take their place; a last row far ahead brings out what waits. Each micro-batch is a restart."""
    every = readings(spark, splits).cache()
    batches = [every.filter(F.floor(F.col("arrival_seq") * splits / 90) == i) for i in range(splits)]
    ahead = spark.createDataFrame([("z", "session", T0 + dt.timedelta(days=9), 1000, 0.0, "none")], every.schema)
    out = {}
    for name, form in (("alerts", lambda s: alerts.threshold_alerts(s, "20 minutes")), ("changes", lambda s: alerts.status_changes(s.withColumn("service", F.col("account")), "20 minutes").select("service", "ts", "arrival_seq", "before", "indicator")), ("gate", lambda s: alerts.significant(s, "account", ["indicator"], "20 minutes"))):
        rows = []
        steps(spark, str(tmp_path / name), [*batches, ahead], lambda s, form=form, rows=rows: form(s).writeStream.foreachBatch(lambda b, n: rows.extend(map(repr, b.collect()))))
        out[name] = sorted(r for r in rows if "'z'" not in r)
    served = every.withColumn("service", F.col("account"))
    assert out["alerts"] == sorted(map(repr, limits.threshold_alerts(every).collect())) and out["alerts"]
    assert out["changes"] == sorted(map(repr, status.changes(served).select("service", "ts", "arrival_seq", "before", "indicator").collect()))
    assert out["gate"] == sorted(map(repr, status.significant(every, "account", ["indicator"]).collect()))


def test_a_restart_tells_no_alert_twice(spark, tmp_path):
    row = lambda i, percent: spark.createDataFrame([("a", "session", T0 + dt.timedelta(minutes=i), i, percent)], "account string, window string, ts timestamp, arrival_seq long, percent double")
    told = []
    steps(spark, str(tmp_path), [row(0, 55.0), row(1, 60.0), row(2, 76.0), row(3, 10.0), row(4, 51.0), row(99, 0.0)], lambda s: alerts.threshold_alerts(s).writeStream.foreachBatch(lambda b, n: told.extend((r.ts.minute, r.band) for r in b.collect())))
    assert told == [(0, 50), (2, 75), (4, 50)]
