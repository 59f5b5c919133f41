"""Calls from captured bytes: pieces cut at random give what whole messages give, in one batch or over micro-batches; broken bytes stop nothing."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from callmeter.operators import exchange
from callmeter.streaming import exchanges

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "conn_id string, seq long, direction string, bytes binary, ts timestamp, closed boolean"


def ask(path, body, chunked=False):
    raw = json.dumps(body).encode()
    if not chunked:
        return b"POST %s HTTP/1.1\r\nContent-Length: %d\r\nX-Request-Id: ask-%d\r\n\r\n%s" % (path.encode(), len(raw), len(raw), raw)
    cut = len(raw) // 3
    return b"POST %s HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n%x\r\n%s\r\n%X;a=b\r\n%s\r\n0\r\nTrailer: t\r\n\r\n" % (path.encode(), cut, raw[:cut], len(raw) - cut, raw[cut:])


def tell(body, code=200, size=None):
    return b"HTTP/1.1 %d Said\r\nContent-Length: %d\r\n\r\n%s" % (code, len(body) if size is None else size, body)


def in_chunks(body, sizes):
    out, at = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n", 0
    while at < len(body):
        n = min(next(sizes), len(body) - at)
        out, at = out + b"%x\r\n%s\r\n" % (n, body[at : at + n]), at + n
    return out + b"0\r\n\r\n"


def pieces(conn, direction, data, seconds, rnd, most):
    """Rows of data cut at random places."""
    cuts = sorted({0, len(data), *(rnd.randrange(len(data) + 1) for _ in range(max(1, len(data) // most)))})
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [b""]
    return [(conn, i, direction, p, T0 + dt.timedelta(seconds=seconds), i == len(parts) - 1) for i, p in enumerate(parts)]


def found(spark, asks, answers, seed=0, most=40):
    rnd = random.Random(seed)
    rows = pieces("c", "request", asks, 0, rnd, most) + pieces("c", "response", answers, 2, rnd, most)
    rnd.shuffle(rows)
    return exchange.calls(exchange.framed(spark.createDataFrame(rows, SCHEMA))).orderBy("n").collect()


FAILED = b'{"error":{"message":"full"}}'
VECTORS = b'{"embeddings":[[0.5]],"prompt_eval_count":21}'
EVENTS = b'data: {"type":"response.reasoning_text.delta"}\r\n\r\nevent: e\ndata:{"type":"response.completed","response":{"id":"id-4","usage":{"input_tokens":70,"output_tokens":"18","output_tokens_details":{"reasoning_tokens":6}}}}\n\ndata: [DONE]\n'


@pytest.mark.parametrize("seed", range(4))
def test_several_answers_on_one_connection(spark, seed):
    asks = ask("/api/chat", {"model": "z-cloud"}) + ask("/api/embed?q=2", {"model": "v"}, chunked=True) + ask("/v1/responses", {"model": "r", "stream": True})
    a, b, c = found(spark, asks, tell(FAILED, 503) + tell(VECTORS) + in_chunks(EVENTS, iter([5, 1, 60, 3, 1000, 1000])), seed, [1000, 40, 11, 3][seed])
    assert (a.status, a.error_category, a.http_status, a.location) == ("failed", "http_503", 503, "cloud")
    assert (b.operation, b.path, b.input, b.status, b.model) == ("embedding", "/api/embed", 21, "succeeded", "v")
    assert (c.request_id, c.input, c.output, c.reasoning, c.approx_output, c.status, c.ttft_s) == ("id-4", 70, 18, 6, 1, "succeeded", 2.0)


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_a_stream_are_timed_and_counted(spark, seed):
    lines = b'{"done":false,"model":"w"}\n' * 3 + b'{"done":true,"done_reason":"length","model":"w","prompt_eval_count":9,"eval_count":12,"eval_duration":500000000,"load_duration":250000000}\n'
    early = b"HTTP/1.1 103 Early Hints\r\nLink: x\r\n\r\n"
    (r,) = found(spark, ask("/api/generate", {"model": "w"}), early + in_chunks(lines, iter([7] * 99)), seed, 25)
    assert (r.input, r.output, r.approx_output, r.finish_reason, r.status, r.load_s) == (9, 12, 3, "length", "succeeded", 0.25) and r.tps == pytest.approx(24)


def test_broken_off_salvaged_and_null_errors(spark):
    one = lambda body, **k: found(spark, ask("/api/chat", {"model": "m"}), tell(body, **k))[0]
    assert (one(b'{"done":false}', size=300).status, one(b'{"done":false}', size=300).display_output) == ("cancelled", 1)
    r = one(b'{"type":"message","error":null,"model":"n","stop_reason":"stop","usage":{"input_tokens":8,"output_tokens":4}}')
    assert (r.status, r.input, r.output, r.finish_reason, r.model) == ("succeeded", 8, 4, "stop", "n")
    r = one(b'{"text: "prompt_eval_count": 7, "eval_count": 3, "done":true')
    assert (r.status, r.input, r.output) == ("succeeded", 7, 3)
    assert one(b'{"error":"null","usage":{"input_tokens":1}}').status == "succeeded" and one(b"[1]").status == "cancelled"


USAGE = b'{"type":"message","usage":{"input_tokens":5,"output_tokens":2}}\n'


@pytest.mark.parametrize(
    ("answers", "expected"),
    [
        (b"HTTP/1.1 abc\r\n\r\n" + tell(USAGE), [(5, "succeeded")]),  # no status: passed over
        (b"\xff\xfe\r\n\r\n" + tell(USAGE), [(5, "succeeded")]),  # no text
        (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n" + USAGE, [(5, "succeeded")]),  # no size: body until the end
        (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n-3\r\n" + USAGE, [(5, "succeeded")]),
        (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\n{}XX\n" + USAGE, [(5, "succeeded")]),  # no end of a chunk
        (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n\r\n" + USAGE, [(5, "succeeded")]),
        (b"HTTP/1.1 204 None\r\nTransfer-Encoding: chunked\r\n\r\n" + tell(USAGE), [(0, "cancelled"), (5, "succeeded")]),
        (b"HTTP/1.1 200 OK\r\nContent-Length: -4\r\n\r\n" + USAGE, [(5, "succeeded")]),
        (b"HTTP/1.1  200\r\n\r\n" + USAGE, [(5, "succeeded")]),
    ],
)
def test_malformed_bytes(spark, answers, expected):
    two = ask("/v1/messages", {"model": "m"}) * 2
    assert [(r.input, r.status) for r in found(spark, two, answers, seed=len(answers), most=9)] == expected


def test_long_lines_and_bodies():
    framer = exchange.Framer(False)
    whole = b"HTTP/1.1 200 OK\r\n\r\n" + b"a" * 3_000_000 + b"\n" + b"b" * 5_000_000 + b"\nc"
    told = [x for i in range(0, len(whole), 5000) for x in framer.feed(whole[i : i + 5000])] + list(framer.close())
    assert [(kind, len(text)) for _, kind, text in told if kind == "line" and len(text) > 5000] == [("line", 3_000_000)] and told[-1][1] == "complete"
    big = exchange.Framer(True)
    n = exchange.BODY_LIMIT + 1
    assert [kind for _, kind, _ in big.feed(b"POST / HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n)] == ["head", "complete"]


def test_a_framer_goes_on_from_its_state():
    rnd = random.Random(2)
    data = tell(FAILED, 500) + in_chunks(EVENTS, iter([4, 9, 2, 400, 400])) + b"HTTP/1.1 200 OK\r\n\r\n" + USAGE
    whole = exchange.Framer(False)
    expected = [*whole.feed(data), *whole.close()]
    for _ in range(30):
        framer, got = exchange.Framer(False), []
        cuts = sorted({0, len(data), *(rnd.randrange(len(data)) for _ in range(rnd.randint(1, 60)))})
        for a, b in zip(cuts, cuts[1:], strict=False):
            framer = exchange.Framer.resume(False, framer.state())
            got += framer.feed(data[a:b])
        assert got + list(framer.close()) == expected


def test_frames_are_made_once_and_lines_parsed_once(spark):
    plan = exchange.calls(exchange.framed(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "variant" not in plan.lower() and "parse_json" not in plan  # both lie before tables that are written


def capture(rnd, connections):
    """Rows of connections with several calls each, one that is never answered, and one whose answer breaks off."""
    rows = []
    for c in range(connections):
        asks, answers = b"", b""
        for i in range(rnd.randint(1, 4)):
            asks += ask(rnd.choice(["/api/chat", "/v1/messages"]), {"model": f"m{i}"}, chunked=rnd.random() < 0.3)
            body = b'{"type":"message","id":"%d-%d","usage":{"input_tokens":%d,"output_tokens":2}}\n' % (c, i, 10 * c + i)
            answers += tell(body) if rnd.random() < 0.5 else in_chunks(body, iter([9] * 99))
        if c % 3 == 1:
            asks += ask("/api/chat", {"model": "never"})
        if c % 3 == 2:
            asks, answers = asks + ask("/api/chat", {"model": "cut"}), answers + tell(b'{"done":false}', size=900)
        rows += pieces(f"c{c}", "request", asks, 0, rnd, 30) + pieces(f"c{c}", "response", answers, 1, rnd, 30)
    return rows


@pytest.mark.parametrize("splits", [1, 5])
def test_micro_batches_give_the_rows_of_one_batch(spark, tmp_path, splits):
    rnd = random.Random(splits)
    rows = capture(rnd, 6)
    shown = ("conn_id", "n", "path", "model", "input", "output", "status", "approx_output", "request_id", "started_at", "ts")
    expected = sorted(map(repr, exchange.calls(exchange.framed(spark.createDataFrame(rows, SCHEMA))).select(*shown).collect()))
    at, told = [rnd.randrange(splits) for _ in rows], []
    for key in {(r[0], r[2]) for r in rows}:  # a direction's pieces keep their order over the micro-batches
        own = [i for i, r in enumerate(rows) if (r[0], r[2]) == key]
        for i, part in zip(own, sorted(at[i] for i in own), strict=True):
            at[i] = part
    run = exchanges.assemble(spark, str(tmp_path / "open"), lambda calls, n: told.extend((n, repr(r)) for r in calls.select(*shown).collect()))
    for part in range(splits):
        spark.createDataFrame([r for r, p in zip(rows, at, strict=True) if p == part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
        assert exchanges.framed(source).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r for _, r in told) == expected and len({n for n, _ in told}) >= min(2, splits)
    left = exchanges.Versions(spark, str(tmp_path / "open"))
    assert left.read(left.folders(left.latest(), "open"), exchange.FRAMED).count() == 0  # all connections are closed: nothing waits


def test_a_silent_connection_is_closed(spark, tmp_path):
    told = []
    run = exchanges.assemble(spark, str(tmp_path / "open"), lambda calls, n: told.extend((r.conn_id, r.status) for r in calls.collect()))
    asks = ask("/api/chat", {"model": "m"})
    quiet = [("q", 0, "request", asks, T0, False), ("q", 0, "response", tell(b'{"done":false}\n', size=99), T0, False)]
    later = [(f"x{i}", 0, "request", b"", T0 + dt.timedelta(seconds=i * 2000), False) for i in (1, 2)]
    for rows in (quiet, later[:1], later[1:]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
        assert exchanges.framed(source).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert told == [("q", "cancelled")]


def test_a_number_that_comes_again_changes_nothing(spark, tmp_path):
    rows = capture(random.Random(1), 2)
    frames = exchange.framed(spark.createDataFrame(rows, SCHEMA))
    numbers = []
    run = exchanges.assemble(spark, str(tmp_path), lambda calls, n: numbers.append((n, calls.count())))
    for n in (0, 0):
        run(frames.withColumn("kind", F.col("kind")), n)
    assert len(numbers) == 1 and numbers[0][1] > 0
