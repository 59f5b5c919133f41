"""Parsers and sources on small fixtures."""

import datetime as dt
import json
import os
import sqlite3

from pyspark.sql import functions as F

from callmeter.operators import limits, reconcile
from callmeter.sources import lines, parse, sqlite


def as_lines(spark, items, path="/logs/a/s1.jsonl"):
    at, out = 0, []
    for x in items:
        text = x if isinstance(x, str) else json.dumps(x)
        out.append((path, at, text, dt.datetime(2024, 1, 1)))
        at += len(text) + 1
    return spark.createDataFrame(out, lines.SCHEMA)


def say(i, out, **more):
    return {"type": "assistant", "timestamp": "2024-01-02T03:04:05.5Z", "cwd": "/x/proj", "requestId": "r", "message": {"id": i, "model": "claude-3", "usage": {"input_tokens": 5, "output_tokens": out}}, **more}


def test_transcripts(spark):
    bad_type = say("m9", 1)
    bad_type["message"]["usage"]["input_tokens"] = "x"
    synthetic = say("m8", 1)
    synthetic["message"]["model"] = "<synthetic>"
    nameless = say(None, 3)
    found = parse.transcripts(as_lines(spark, [say("m1", 0), say("m1", 9), say("m1", 2), bad_type, synthetic, nameless, nameless, "{bad \"assistant\""]))
    full = found.withColumns({c: __import__("pyspark").sql.functions.lit(None).cast("double") for c in ("duration_s", "ttft_s", "tps", "load_s")})
    best = {r.dedup_key: r for r in reconcile.strongest_per_key(full).collect()}
    assert best["m1:r"].output_tokens == 9 and best["m1:r"].provider == "claudeCode" and best["m1:r"].project == "proj" and best["m1:r"].session_id == "s1"
    assert len(best) == 3  # m1 and two calls without an id


def test_codex(spark):
    def usage(i, o):
        return {"timestamp": "2024-01-02T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "output_tokens": o, "cached_input_tokens": 1, "reasoning_output_tokens": 2}}, "rate_limits": {"primary": {"used_percent": 12.5, "window_minutes": 300, "resets_at": 1.7e9}}}}

    rows = as_lines(spark, [usage(1, 1), {"type": "session_meta", "payload": {"id": "S", "cwd": "/a/p"}}, {"type": "turn_context", "payload": {"model": "m-a"}}, usage(3, 4), {"type": "turn_context", "payload": {"model": ""}}, usage(0, 0), {"type": "turn_context", "payload": {"model": "m-b"}}, usage(5, 6)])
    got = [(r.model, r.session_id, r.project, r.input_tokens, r.reasoning) for r in parse.codex_sessions(rows).orderBy("arrival_seq").collect()]
    assert got == [("Codex", "s1", None, 1, 2), ("m-a", "S", "p", 3, 2), ("m-b", "S", "p", 5, 2)]
    assert parse.codex_quota(rows).count() == 4


def test_lmstudio_keeps_no_content(spark):
    stats = {"promptTokensCount": "31", "predictedTokensCount": 44, "reasoningTokensCount": "5", "tokensPerSecond": 21.25, "timeToFirstTokenSec": 1.75, "stopReason": "length"}
    rows = as_lines(spark, [{"timestamp": "2025-03-02T05:06:07Z", "data": {"type": "llm.prediction.output", "predictionId": "abc", "modelIdentifier": "small", "output": "SECRET", "stats": stats}}, {"data": {"type": "llm.prediction.input"}}, {"data": {"type": "llm.prediction.output"}}])
    (r,) = parse.lmstudio(rows).collect()
    assert (r.dedup_key, r.input_tokens, r.output_tokens, r.reasoning, r.tps, r.ttft_s) == ("lmstudio:abc", 31, 44, 5, 21.25, 1.75)
    assert r.ts == dt.datetime(2025, 3, 2, 5, 6, 7) and "SECRET" not in str(r)


def test_names(spark):
    rows = as_lines(spark, [{"type": "user", "message": {"content": "<cmd>"}}, {"type": "user", "isMeta": True, "message": {"content": "meta"}}, {"type": "user", "message": {"content": [{"type": "text", "text": "a\n" + "b" * 80}]}}, {"type": "user", "sessionId": "other", "message": {"content": "first"}}, {"type": "ai-title", "aiTitle": "T", "sessionId": "other"}, {"type": "ai-title", "aiTitle": "T2", "sessionId": "other"}])
    assert {r.session: r.name for r in parse.session_names(rows).collect()} == {"s1": "a " + "b" * 58 + "…", "other": "T2"}


def test_history_and_legacy(spark):
    old = json.dumps({"days": {"2024-01-01": {"claudeIn": 20, "claudeOut": 9, "ollamaIn": 0, "ollamaOut": 0, "codexCache": 4, "calls": 6}, "2024-01-02": {"providers": {"codex": {"input": 1, "output": 2}}}}})
    got = {(str(r.day), r.provider): r.input + r.output for r in parse.history(spark.createDataFrame([(old,)], "json string")).collect()}
    assert got == {("2024-01-01", "claudeCode"): 29, ("2024-01-01", "codex"): 0, ("2024-01-02", "codex"): 3}
    two = parse.legacy_journal(as_lines(spark, [{"ts": 1.5, "model": "m", "input": 1, "output": 2, "cacheR": 0, "cacheC": 0}, {"ts": 1.5, "model": "m", "input": 1, "output": 2, "cacheR": 9, "cacheC": 0}, "junk"])).collect()
    assert [r.cache_read for r in two] == [9]


def test_offset_lines(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    text = [f"line {i} é" for i in range(50)]
    raw = "\n".join(text) + "\npartial"
    (tmp_path / "sub/a.jsonl").write_text(raw)
    (tmp_path / ".hidden.jsonl").write_text("no\n")
    lines.register(spark)
    for size in ("7", "64", "100000"):
        got = spark.read.format("offset_lines").option("path", str(tmp_path)).option("range_bytes", size).load().orderBy("byte_offset").collect()
        assert [r.line for r in got] == [*text, "partial"]
        assert all(raw.encode()[r.byte_offset :].startswith(r.line.encode()) for r in got)


def test_tailing(spark, tmp_path):
    logs, f = tmp_path / "logs", tmp_path / "logs/a.jsonl"
    logs.mkdir()
    f.write_text("one\ntw")
    lines.register(spark)

    def run():
        q = spark.readStream.format("offset_lines").option("path", str(logs)).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return sorted((r.byte_offset, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, "one")]
    f.write_text("one\ntwo\nthree\n")
    assert run() == [(0, "one"), (4, "two"), (8, "three")]


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "d.db")
    con.execute("create table messages (id integer primary key, chat_id text, model_name text, role text, created_at text, updated_at text, stream integer, content text)")
    con.executemany("insert into messages values (?,?,?,?,?,?,?,?)", [(i, "c1", None if i % 2 else "m", "assistant", "2024-01-01 00:00:00", "2024-01-01 00:00:08", int(i == 5), "SECRET") for i in range(1, 6)])
    con.commit()
    con.close()
    sqlite.register(spark)
    raw = spark.read.format("sqlite_table").option("path", str(tmp_path / "d.db")).option("table", "messages").option("rows_per_task", "2").load()
    rows = parse.desktop_rows(raw).orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.model, r.duration_s, r.token_accuracy, r.input_tokens) for r in rows] == [(1, "", 8.0, "unknown", 0), (2, "m", 8.0, "unknown", 0), (3, "", 8.0, "unknown", 0), (4, "m", 8.0, "unknown", 0)]


def test_quota_walk(spark):
    doc = json.dumps({"a": {"b": [{"used_percent": 40, "window_minutes": 10080}, {"utilization": 20.5, "limit_window_seconds": 18000, "reset_at": 1.8e9}]}, "c": {"used_percent": 140, "window_minutes": 1}, "d": {"used_percent": 7}})
    got = [(r.window, r.percent, r.minutes) for r in limits.quota_walk(spark.createDataFrame([("x", doc), ("y", "junk")], "account string, json string")).orderBy("window").collect()]
    assert got == [("primary", 20.5, 300), ("secondary", 40.0, 10080)]


def test_account_windows(spark):
    doc = json.dumps({"five_hour": {"utilization": 12, "resets_at": "2024-01-01T00:00:00Z"}, "seven_day": {}})
    got = {r.window: r.utilization for r in limits.account_windows(spark.createDataFrame([("x", doc)], "account string, json string")).collect()}
    assert got == {"session": 12.0, "weekly": 0.0}


def test_loaded_models(spark):
    raw = spark.createDataFrame([("a", '{"models":[{"name":"x","size":2,"size_vram":1}]}'), ("b", '[{"identifier":"y","sizeBytes":3}]'), ("c", None)], "provider string, json string")
    models = parse.loaded_models(raw)
    assert {(r.provider, r.model, r.size) for r in models.collect()} == {("a", "x", 2), ("b", "y", 3)}
    assert {r.fingerprint for r in parse.model_fingerprint(models).collect()} == {"x@2@1", "y@3@"}


def test_a_line_of_five_megabytes_is_kept(spark, tmp_path):
    long = "x" * 5_000_000
    (tmp_path / "a.jsonl").write_text(f"one\n{long}\nthree\n")
    lines.register(spark)
    read = lambda **o: [len(r.line) for r in spark.read.format("offset_lines").options(path=str(tmp_path), **o).load().orderBy("byte_offset").collect()]
    assert read() == read(range_bytes="1000000") == [3, 5_000_000, 5]
    assert read(max_line="4000000") == [3, 5]


def test_quota_objects_at_any_depth(spark):
    doc = json.dumps({"used_percent": 9, "window_minutes": 5})
    for _ in range(9):
        doc = '{"x":[%s]}' % doc
    (r,) = limits.quota_walk(spark.createDataFrame([("a", doc)], "account string, json string")).collect()
    assert (r.percent, r.minutes) == (9.0, 5) and not [t for t in spark.catalog.listTables() if "walk" in t.name]
    assert limits.quota_walk(spark.createDataFrame([("a", None), ("b", "[]")], "account string, json string")).count() == 0


def test_pending_rows_are_looked_up_again(spark):
    schema = "id long, role string, stream int"
    now = spark.createDataFrame([(1, "assistant", 0), (2, "assistant", 0), (3, "assistant", 1), (6, "assistant", 0), (7, "assistant", 1), (8, "user", 0)], schema)
    done, open_ = sqlite.increment(now, 5, spark.createDataFrame([(2, 0), (3, 1), (4, 0), (5, 1)], "id long, misses int"))
    assert sorted(r.id for r in done.collect()) == [2, 6]  # 1 was seen before and is not pending
    assert sorted(map(tuple, open_.collect())) == [(3, 0), (4, 1), (7, 0)]  # 5 is missing for the second time


def test_a_tail_reads_bounded_batches(spark, tmp_path):
    """Files that grow, shrink and come, a partial last line, restarts: each line once, a number as offset, no batch over its bytes."""
    logs = tmp_path / "logs"
    logs.mkdir()
    lines.register(spark)

    def run():
        source = spark.readStream.format("offset_lines").options(path=str(logs), offsets=str(tmp_path / "offsets"), max_bytes="300", max_files="3", range_bytes="64").load()
        q = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        progress = q.recentProgress
        q.stop()
        return sorted((r.path.rsplit("/", 1)[1], r.byte_offset, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()), progress

    texts = {f"f{i}.jsonl": "".join(f"file {i} line {j} é\n" for j in range(20)) for i in range(7)}
    for name, text in texts.items():
        (logs / name).write_text(text + "half of a li")
    expected = lambda: sorted((n, len("".join(t.splitlines(True)[:j]).encode()), line) for n, t in texts.items() for j, line in enumerate(t.splitlines()))
    found, progress = run()
    assert found == expected()
    assert all(len(p.sources[0].endOffset) < 40 for p in progress) and len([p for p in progress if p.numInputRows]) >= 7
    assert all(p.numInputRows <= 300 / 15 + 1 for p in progress)
    for name in texts:
        texts[name] += "half of a line\n"
        (logs / name).write_text(texts[name])
    texts["new.jsonl"] = "x" * 1000 + "\nend\n"
    (logs / "new.jsonl").write_text(texts["new.jsonl"])
    assert run()[0] == expected()
    assert run()[0] == expected()  # nothing is new


def test_a_tail_of_many_files_plans_in_small_pieces(tmp_path, monkeypatch):
    """100,000 files and ten gigabytes: no file is opened to plan, every byte is planned once, and a new start goes on."""

    class Info:
        def __init__(self, i, size):
            self.path, self.size, self.mtime = f"/logs/{i:06d}.jsonl", size, dt.datetime(2024, 1, 1)

    files = [Info(i, 100_000) for i in range(100_000)]
    monkeypatch.setattr(lines._Files, "files", lambda self: files)
    options = {"path": "/logs", "offsets": str(tmp_path), "max_bytes": str(2 << 30), "max_files": "30000"}
    stream, seen, at = lines.OffsetLinesStream(options), {}, {"n": -1}
    for _ in range(20):
        end = stream.latestOffset()
        if end == at:
            break
        parts = stream.partitions(at, end)
        assert len(json.dumps(end)) < 1000 and sum(p.end - p.start for p in parts) <= 2 << 30 and len(parts) <= 30_000
        for p in parts:
            assert seen.get(p.path, 0) == p.start
            seen[p.path] = p.end
        stream.commit(end)
        at = end
        stream = lines.OffsetLinesStream(options)
    assert seen == {f.path: f.size for f in files}


def test_filters_reach_the_files(spark, tmp_path):


    for i in range(4):
        (tmp_path / f"f{i}.jsonl").write_text(f"{i}\n")
        os.utime(tmp_path / f"f{i}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    lines.register(spark)
    read = lambda: spark.read.format("offset_lines").option("path", str(tmp_path)).load()
    later = read().filter(F.col("mtime") >= F.lit(1_700_000_002).cast("timestamp"))
    assert sorted(r.line for r in later.collect()) == ["2", "3"] and later.rdd.getNumPartitions() == 2 < read().rdd.getNumPartitions()
    one = read().filter(F.col("path").startswith(str(tmp_path / "f1")) & (F.col("byte_offset") >= 0))
    assert [r.line for r in one.collect()] == ["1"] and one.rdd.getNumPartitions() == 1
    assert read().filter(F.col("path").isin(str(tmp_path / "f0.jsonl"), "x") | (F.col("line") == "3")).count() == 2


def test_sqlite_ranges_and_columns(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "d.db")
    con.execute("create table messages (id integer primary key, chat_id text, role text, stream integer, content text)")
    con.executemany("insert into messages values (?,?,?,?,?)", [(i, f"c{i}", "assistant", 0, "SECRET") for i in range(1, 101)])
    con.commit()
    con.close()
    sqlite.register(spark)
    read = lambda: spark.read.format("sqlite_table").schema("chat_id string, id long").options(path=str(tmp_path / "d.db"), table="messages", rows_per_task="10").load()
    some = read().filter("id > 35 and id <= 60")
    assert sorted(map(tuple, some.collect())) == sorted((f"c{i}", i) for i in range(36, 61)) and some.rdd.getNumPartitions() == 3 < read().rdd.getNumPartitions()
    assert read().filter("id in (3, 7)").rdd.getNumPartitions() == 1 and read().filter("id = 1000").count() == 0


def test_sqlite_stream(spark, tmp_path):
    """Looks with restarts: rows in flight wait, missing ones are given up at the second look, nothing comes twice."""
    path = tmp_path / "d.db"
    con = sqlite3.connect(path)
    con.execute("create table messages (id integer primary key, chat_id text, model_name text, role text, created_at text, updated_at text, stream integer)")
    add = lambda i, role="assistant", stream=0: con.execute("insert into messages values (?,?,?,?,?,?,?)", (i, "c", "m", role, "t", "t", stream))
    sqlite.register(spark)

    def look():
        con.commit()
        source = spark.readStream.format("sqlite_table").options(path=str(path), table="messages", offsets=str(tmp_path / "looks"), rows_per_task="2").load()
        source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema(source.schema).parquet(str(tmp_path / "out")).collect())

    for i in range(1, 6):
        add(i, stream=int(i in (2, 4)))
    add(6, role="user")
    assert look() == [1, 3, 5]
    con.execute("update messages set stream = 0 where id = 2")
    con.execute("delete from messages where id = 4")
    add(7, stream=1)
    add(8)
    assert look() == [1, 2, 3, 5, 8]
    assert look() == [1, 2, 3, 5, 8]
    add(4)  # back after it was given up
    con.execute("update messages set stream = 0 where id = 7")
    assert look() == [1, 2, 3, 5, 7, 8]
    assert json.loads((tmp_path / "looks/look.json").read_text()) == {"last": 8, "pending": {}}
