"""What must not grow faster than the input: tasks, tables that stay behind, and bytes that are moved."""

from callmeter.sources import lines


def test_small_ranges_share_tasks(spark, tmp_path):
    """A task for each range of 2000 bytes made 500,000 of a gigabyte."""
    with open(tmp_path / "big.jsonl", "wb") as f:
        f.truncate(1 << 30)
    parts = lines.OffsetLinesReader({"path": str(tmp_path), "range_bytes": "2000"}).partitions()
    assert 200 < len(parts) < 300
    told = [(r.start, r.end) for p in parts for of in p.ranges() for r in of]
    assert told == [(at, min(at + 2000, 1 << 30)) for at in range(0, 1 << 30, 2000)]


def test_runs_of_ranges_over_files(spark, tmp_path):
    """Lines shorter and longer than a range, in many small files and a larger one, each once and at its offset."""
    want = set()
    for i in range(40):
        made, at = [], 0
        for k in range(30_000 if i == 39 else i):
            line = f"{i}-{k} é ".encode() + b"x" * (k * 37 % 90)
            want.add((f"{i:02d}.jsonl", at, line.decode()))
            made.append(line)
            at += len(line) + 1
        (tmp_path / f"{i:02d}.jsonl").write_bytes(b"\n".join(made) + b"\n" * (i % 2))
    lines.register(spark)
    found = spark.read.format("offset_lines").option("path", str(tmp_path)).option("range_bytes", "50").load()
    assert found.rdd.getNumPartitions() < 20
    rows = [(r.path.rsplit("/", 1)[1], r.byte_offset, r.line) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_short_lines_do_not_copy_their_block():
    """Each line copied what was left of its block of a megabyte: 400,000 short lines moved some 200 GB."""
    import io
    import time

    data = b"".join(b"%d\n" % (k % 10) for k in range(400_000)) + b"\n\nwithout end"
    began, found, held = time.process_time(), [], lines._Lines(io.BytesIO(data), 0, None)
    while (line := held.next()) is not None:
        found.append(line)
    assert found == data.split(b"\n") and held.at == len(data) and not held.ended
    assert time.process_time() - began < 4


def test_scratch_tables_of_a_scope_go(spark):
    """What near-duplicates write on the way stood until the driver's end."""
    from pathlib import Path

    from callmeter.scratch import kept, passing, shared_folder, written

    there = lambda: {p.name.split("-")[0] for p in Path(shared_folder(spark).removeprefix("file://"), "callmeter").iterdir()}
    with passing():
        with passing():
            written(spark.range(3), "inner_gone")
            two = kept(written(spark.range(3), "inner_kept"))
        assert "inner_gone" not in there() and two.count() == 3
        three = kept(written(two, "outer_kept"))
    assert "inner_kept" not in there() and three.count() == 3


def test_near_duplicates_leave_no_sets_and_parts_lose_no_link(spark, monkeypatch):
    from pathlib import Path

    from callmeter.llm import near_dedup
    from callmeter.scratch import shared_folder

    words = lambda i: [f"w{i}x{k}" for k in range(60)]
    texts = [(10 * i + j, " ".join([*words(i), *[f"v{j}"] * (j > 0)])) for i in range(30) for j in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    folder = Path(shared_folder(spark).removeprefix("file://"), "callmeter")
    count = lambda: len(list(folder.glob("sets-*")) + list(folder.glob("confirmed-*")) + list(folder.glob("edges-*")))
    before = count() if folder.exists() else 0
    monkeypatch.setattr(near_dedup, "PART_PAIRS", 8)
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {d: d // 10 * 10 for d, _ in texts}
    assert count() == before


def test_components_take_few_jobs_and_forests_lose_no_link(spark, monkeypatch):
    """Each round of stars was ten jobs, six exchanges and two broadcasts of the driver's, however few the edges were."""
    import random

    from callmeter.llm import common

    rng = random.Random(3)
    chain = list(range(-60, 60))
    rng.shuffle(chain)
    pairs = [*zip(chain, chain[1:]), *[(1000 + rng.randrange(150), 1000 + rng.randrange(150)) for _ in range(90)], (-(1 << 63), (1 << 63) - 1), (5, 5), (7000, 7000), (None, 3)]
    want = {x: {x} for x in {x for u, v in pairs if u != v and u is not None for x in (u, v)}}
    for u, v in pairs:
        if u != v and u is not None and want[u] is not want[v]:
            want[u] |= want[v]
            want |= dict.fromkeys(want[v], want[u])
    want = sorted((x, min(held)) for x, held in want.items())
    edges = spark.createDataFrame(pairs * 2, "u long, v long").repartition(5)
    spark.sparkContext.setJobGroup("components", "")
    try:
        found = sorted(map(tuple, common.components(edges).collect()))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == want and 0 < jobs < 8
    assert common.components(edges.limit(0)).count() == 0
    monkeypatch.setattr(common, "FOREST_EDGES", 9)
    assert sorted(map(tuple, common.components(edges).collect())) == want
    # a task with more edges than it joins at a time gives several forests
    forests = common._forests(edges.filter("u <> v").coalesce(1), 9)
    assert sorted(map(tuple, common.components(forests).collect())) == want


def test_stored_rows_come_from_the_exchange_by_key_and_changes_from_none(spark, tmp_path, monkeypatch):
    """Whole rows were joined again with the winners' keys, and changes were dealt by a column of one value."""
    from callmeter.sources.adapter import usage_events
    from callmeter.streaming import store as stores

    x = usage_events(spark, "/root/testdata/sf0.001")
    plans = {}
    store = stores.Store(spark, f"file://{tmp_path}/calls")
    store.upsert()(x.filter("arrival_seq % 2 = 0"), 0)
    write = store.versions.write

    def seen(state, rows, table, by, **named):
        plans[table] = (rows._jdf.queryExecution().optimizedPlan().toString(), named)
        return write(state, rows, table, by, **named)

    monkeypatch.setattr(store.versions, "write", seen)
    store.upsert()(x, 1)
    assert "Join" not in plans["rows"][0] and plans["changes"][1] == {"one": True}
    assert store.rows().count() == x.count()


def test_collected_lines_are_read_once(spark, tmp_path):
    """Rows without a key are taken beside the strongest of each key; lines whose parsers always give a key were read again for them."""
    from callmeter.operators.reconcile import strongest_per_key
    from callmeter.sources import collect, parse

    (tmp_path / "a.jsonl").write_text("{}\n")
    lines.register(spark)
    read = spark.read.format("offset_lines").option("path", str(tmp_path)).load()
    for found in (parse.transcripts(read), parse.lmstudio(read), parse.codex_sessions(read)):
        events = collect.as_usage_events(found)
        assert not events.schema["dedup_key"].nullable
        assert " Union" not in strongest_per_key(events)._jdf.queryExecution().optimizedPlan().toString()
    made = spark.createDataFrame([("p", 5, '{"type":"assistant","message":{"model":"m","usage":{"input_tokens":1}}}', None), ("p", 9, '{"type":"assistant","requestId":"r","message":{"id":"i","model":"m","usage":{}}}', None)], "path string, byte_offset long, line string, mtime timestamp")
    assert sorted(r.dedup_key for r in parse.transcripts(made).collect()) == ["i:r", "p:5"]


def test_a_journal_is_compressed_in_bounded_files_and_read_once(spark, tmp_path, monkeypatch):
    """Plain lines made 20 times the bytes of the rows' Parquet, and each load read them twice, once for rows without a key, of which there are none."""
    from callmeter import sinks, versions
    from callmeter.sources import collect
    from callmeter.sources.adapter import usage_events

    monkeypatch.setattr(versions, "FILE_LINES", 100)
    rows, folder = collect.as_usage_events(usage_events(spark, "/root/testdata/sf0.001")).coalesce(1), str(tmp_path / "journal")
    sinks.append_journal(rows, folder)
    files = list((tmp_path / "journal").glob("lines/*/part-*"))
    n = rows.count()
    assert len(files) == -(-n // 100)
    plain = sinks.journal_lines(rows).selectExpr("sum(octet_length(value)) as n").first().n
    assert sum(f.stat().st_size for f in files) < plain / 3
    loaded = sinks.load_journal(spark, folder, "2024-01-01 00:00:00")
    assert loaded._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert sorted(map(tuple, loaded.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_shadows_are_one_stream_join_and_batches_are_planned_by_the_stores_session(spark, tmp_path):
    """Two joins committed twice the state stores; a micro-batch's own session has no adaptive plans, so what followed was 200 tasks an exchange."""
    from callmeter.scratch import written
    from callmeter.sources.adapter import usage_events
    from callmeter.streaming import shadows

    x = spark.readStream.schema(usage_events(spark, "/root/testdata/sf0.001").schema).parquet(str(tmp_path))
    assert shadows.pairs(x)._jdf.queryExecution().analyzed().toString().count("Join Inner") == 1
    other = spark.newSession()
    other.conf.set("spark.sql.adaptive.enabled", "false")
    table = written(other.range(3), "own", spark)
    assert table.sparkSession is spark and table.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true" and table.count() == 3


def test_copies_of_one_text_are_not_compared_with_each_other(spark, monkeypatch):
    """Copies that lost the same words of a text shared these, so the pairs that were compared grew with the square of the copies."""
    import random

    from callmeter.llm import near_dedup

    r, base = random.Random(5), [f"w{k}" for k in range(300)]

    def copy(i, n, own):
        words = list(base)
        for k in r.sample(range(300), n):
            words[k] = f"{own}x{k}"
        return i, " ".join(words)

    # most are far from the text (the first row) and from each other; some are near it, and of the far ones a few have the same new words
    rows = [(0, " ".join(base))] + [copy(i, 2 + i % 5 if i % 4 == 0 else r.randint(8, 16), f"v{i if i % 10 else i % 3}") for i in range(1, 160)]
    rows += [(1000 + i, rows[i][1].replace("w7 ", "z7 ", 1).replace("w200 ", "z ", 1)) for i in range(1, 160, 9)]
    sets = {d: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    want = {d: d for d in sets}
    for x in sets:
        for y in sets:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]) and want[x] != want[y]:
                least, gone = sorted((want[x], want[y]))
                want = {d: least if c == gone else c for d, c in want.items()}
    assert 20 < len(set(want.values())) < 150

    compared, cut = [], near_dedup.cut

    def seen(df, name, *more):
        table = cut(df, name, *more)
        if name == "groups":
            compared.append(table.select("g", "members").distinct().selectExpr("coalesce(sum(members * members), 0)").first()[0])
        return table

    monkeypatch.setattr(near_dedup, "cut", seen)
    monkeypatch.setattr(near_dedup, "FEW", 4)
    found = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want
    assert compared and sum(compared) < 100_000
