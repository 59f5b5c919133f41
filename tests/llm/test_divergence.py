"""Divergence of sources against plain counting, over odd rows and small segments."""

import random
import re
from collections import Counter, defaultdict

import pytest

from callmeter.llm import divergence

SCHEMA = "lang string, source string, text string, number long, p long, total long, value string, rank string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, top):
    rows = [(a or "", b or "", re.findall(r"[a-z\x80-\U0010ffff]+", (c or "").translate(UPPER))) for a, b, c in rows]
    out = []
    for lang in {r[0] for r in rows}:
        of, counts = Counter(), defaultdict(Counter)
        for a, source, terms in rows:
            if a == lang:
                of.update(set(terms))
                counts[source].update(terms)
        kept = [t for t in of if of[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s)
            terms = sorted((-apart(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("segment", [4096, 3])
def test_plain_counting(spark, monkeypatch, segment):
    monkeypatch.setattr(divergence, "SEGMENT", segment)
    rnd = random.Random(2)
    rows = [(rnd.choice(["en", "fr", None, ""]), rnd.choice(["a", "b", "c", None, "", "é"]), " ".join(rnd.choice(["One", "two", "zwölf", "ÄÖ", "1x2", "émil", "q", "\U0001f600", "a-b"]) for _ in range(rnd.randint(0, 12)))) for _ in range(150)]
    rows += [("xx", "only", "lonely"), ("yy", "a", None), ("yy", "b", ""), ("yy", "c", "12 34"), *[("zz", "a", "same same")] * 10, ("zz", "b", "other"), ("zz", "c", "same"), ("en", "a", "\x00two\x00")]
    found = divergence.divergence(frame(spark, rows), least=4, top=5)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == expected(rows, 4, 5)


def test_counts_beyond_longs_and_bounded_tables(spark, monkeypatch):
    """SCALE times a count leaves 64 bits; texts are cut and tables passed on without losing a term."""
    n = spark.createDataFrame([(20_000_000_000, 60_000_000_000, 7)], "n long, total long, v long")
    assert n.select(divergence._share(n.n, n.total, n.v)).first()[0] == 1 + 10**9 * (20_000_000_002) // (60_000_000_014)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 64)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    rows = [("en", f"s{i % 3}", " ".join(f"{'xyz'[i % 3]}{chr(97 + j % 26)}" * (1 + j % 40) for j in range(100))) for i in range(12)]
    assert sorted(map(tuple, divergence.divergence(frame(spark, rows), least=2, top=4).collect())) == expected(rows, 2, 4)


def test_no_rows(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []


def test_no_rows_are_compared_with_all_others(spark):
    plan = divergence.divergence(frame(spark, [("en", "a", "one two")] * 12))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
