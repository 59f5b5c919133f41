"""Periodic runs against brute force over all periods and starts, with planted and random repeats, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from callmeter.llm import periodic

SCHEMA = "doc_id long, text string, runs string, start string, h long, w string, a int, p int"


def brute(words):
    """(start, length, period) of all runs, by testing every start and period."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            smaller = lambda: any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q))  # noqa: B023, E731
            if j + q - i >= max(6, 4 * q) and not smaller():
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    text = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def repeats(rnd, most=30):
    words = []
    for _ in range(rnd.randint(0, 5)):
        base = [rnd.choice("abcdef") for _ in range(rnd.randint(1, most))]
        words += (base * 9)[: rnd.randint(1, len(base) * 9)] + [rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 5))]
    return words


@pytest.mark.parametrize("slice_words", [1 << 17, 32])
@pytest.mark.parametrize("small", [periodic.SMALL, (1, 1)])
def test_brute_force(monkeypatch, slice_words, small):
    """Both primes, and blocks dealt into pieces."""
    monkeypatch.setattr(periodic, "SLICE_WORDS", slice_words)
    monkeypatch.setattr(periodic, "SMALL", small)
    rnd = random.Random(11)
    for _ in range(60):
        docs = [repeats(rnd) for _ in range(rnd.randint(1, 5))]
        found = list(periodic._group([(i, " ".join(d).encode()) for i, d in enumerate(docs)]))
        assert [[tuple(r.values()) for r in f[-1]] for f in found] == [brute(d) for d in docs]


@pytest.mark.parametrize("block", [1, 2, 8, 64])
def test_sums_of_squares_are_exact(block):
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 3, 10 * block)
    zero = periodic.zero_distances(x, block, periodic.Transform(2 * block))
    y = np.concatenate([x, np.zeros(3 * block, x.dtype)])
    for lag in range(block):
        for j in range(10):
            at = j * block
            assert zero[lag, j] == (((y[at : at + block] - y[at + block + lag : at + 2 * block + lag]) ** 2).sum() % 65537 == 0)


def test_query_rows(spark, tmp_path):
    rnd = random.Random(4)
    texts = [" ".join(repeats(rnd, 12)) for _ in range(200)] + [None, "", " \t\n\x0b\x0c\r ", "x", "a " * 5, "a\ta\na\x0ba\x0ca\ra", "           ", "\x1c a \x1c a \x1c a \x1c a", "é É é É é É é É"]
    rows = [(i, t, "x", None, 1, "w", 2, 3) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a a a a a a", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "other b b b b b b b", None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for plant, found in ((True, periodic.op13_periodic_runs(spark, str(tmp_path))), (False, periodic.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet")).drop("runs"))):
        assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(expected(r[0], r[1], plant)) for r in rows)


def test_whole_table(spark):
    from callmeter.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 3000}
    found = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(found) == len(docs)
    for doc_id, text in short.items():
        assert found[doc_id] == expected(doc_id, text, True)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and found[i][1] for i in found)


def test_long_texts_in_bounded_time():
    """Words all equal, and a period of a hundred thousand words (a block beyond the small prime)."""
    (row,) = periodic._group([(1, b"a " * 300_000)])
    assert row[:6] == (1, 1, 0, 300_000, 1, 300_000_000)
    (row,) = periodic._group([(1, b"first " + b" ".join(b"%d" % (i % 100_000) for i in range(450_000)))])
    assert row[:6] == (1, 1, 1, 450_000, 100_000, 4500)


def test_no_rows(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
