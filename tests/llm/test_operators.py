"""The ten operators on small tables: brute force, round trips, and the defined results of odd rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callmeter.llm import common, decontaminate, licenses, media, mixing, near_dedup, pii, quality, toxicity, url_lists, warc

LONG = "Numbers such as 12 km and words " * 20_000
TEXTS = [None, "", " ", "one", "One two", "a b c d e f", "A B C D E F", "a b c d e f", LONG, "Ümläut \U0001f600 ends", "x" * 70, "Mail bob@example.org or +1 (555) 123-4567 now."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, spans int, base int, label string"


def table(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, f"source-{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    path = str(tmp_path_factory.mktemp("odd"))
    table(spark, [*rows, rows[3], (None, "no id here"), (None, None), (3, "one other text")]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    table(spark, []).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


# 1 Media ----------------------------------------------------------------------------------------


def through_media(spark, docs, **options):
    folder = common.scratch(spark, "media")
    media.write(docs, folder).collect()
    return media.features(media.read(spark, folder, **options))


@pytest.mark.parametrize("options", [{}, {"range_bytes": "200"}])
def test_media_round_trip(spark, odd, options):
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in through_media(spark, odd, **options).collect()))
    expected = []
    for r in odd.collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        expected.append((r.doc_id is None, r.doc_id or 0, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert found == sorted(expected)


def test_media_empty(spark, empty):
    assert through_media(spark, empty).count() == 0


def test_media_member_is_retried_alone():
    calls, opened = [], []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost")
        return b"x"

    assert media.retried(read, lambda: opened.append(1)) == b"x" and len(opened) == 2
    with pytest.raises(zlib.error):
        media.retried(lambda: (_ for _ in ()).throw(zlib.error()), lambda: None, 2)


# 2 WARC -----------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, size int"
BIG = "<p>" + "y" * 1200


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b", BIG), (2, None, BIG), (9, "http://c", BIG), (4, "http://d", "small"), (5, "http://e", "small"), (6, "http://f", None), (7, "", "é" * 600), (None, "http://g", BIG)]
    pages, folder = table(spark, rows, PAGES), common.scratch(spark, "warc")
    warc.write(pages, folder).collect()
    found = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert len(found) == len(rows)
    assert {k: (r.record_type, r.refers_to) for k, r in found.items() if k in (1, 2, 9, 4, 5)} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), 4: ("response", None), 5: ("response", None)}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        assert (found[page_id].payload_bytes, found[page_id].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert bytes(found[7].payload) == ("é" * 600).encode() and found[2].url == "urn:page:2"


def test_warc_empty(spark):
    folder = common.scratch(spark, "warc")
    warc.write(table(spark, [], PAGES), folder).collect()
    assert warc.read(spark, folder).count() == 0


@pytest.mark.parametrize("change", [(b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WARC/9"), (b"WARC-Date", b"X"), (b"sha1:", b"sha1:0")])
def test_warc_record_is_validated(change):
    whole = warc._record(3, "http://a", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse(whole)[0] == 3
    with pytest.raises(ValueError):
        warc.parse(whole.replace(*change, 1))


# 3 Decontamination ------------------------------------------------------------------------------

QUESTION = "A train leaves the old station at 45 km each hour and meets another train that left the small harbour 3 hours before it did"


def test_decontamination(spark):
    bench = table(spark, [(1, QUESTION), (2, "too short"), (3, None)], "item_id long, text string, of int")
    docs = [
        (1, "Intro words. " + QUESTION + " and more follows here."),
        (2, "Before. " + QUESTION.replace("45", "80").replace("3 hours", "7 hours") + "."),  # other numbers
        (3, QUESTION.replace("45", "80").replace("3 hours", "80 hours")),  # two values of the item became one
        (4, "Nothing of this kind stands here, at 45 km each hour or otherwise, in any of its words at all"),
        (5, None),
        (6, ""),
        (1, "Intro words. " + QUESTION + " and more follows here."),
    ]
    found = {r.doc_id: r for r in decontaminate.contaminated(table(spark, docs, "doc_id long, text string, h int"), bench).collect()}
    assert set(found) == {1, 2} and not found[1].changed and found[2].changed and found[1].item_id == 1
    kept = decontaminate.keep_clean(table(spark, docs, "doc_id long, text string, h int"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == ["doc_id", "text", "h"]


def test_decontamination_by_slot(spark):
    frame = "Early in the morning {} apples were put into the wooden box that stood behind the door of the old barn and later on that day {} pears were laid beside them by the farmer who had gathered these in the garden near the river"
    more = " while the children who lived there kept looking for any nuts which the wind might have thrown down over the long wet grass"
    bench = table(spark, [(1, frame.format(12, 12) + more), (2, frame.format(45, 3).replace("apples", "plums") + more)], "item_id long, text string")
    docs = [
        (1, frame.format(7, 9) + more),  # one number of the item in two slots, changed apart
        (2, frame.format(12, 9) + more),  # word for word but for one of two equal numbers
        (3, frame.format(80, 80).replace("apples", "plums") + more),  # new values that coincide
        (4, frame.format(7, 7) + more),
        (5, "Each of {} words here stands in another order, and {} pears were not meant by any of them".format(7, 9)),
    ]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table(spark, docs, "doc_id long, text string"), bench).collect()}
    assert set(found) >= {(1, 1), (2, 1), (3, 2), (4, 1)} and all(d != 5 for d, _ in found)
    assert found[4, 1].coverage == 1 > found[1, 1].coverage and found[2, 1].changed


def test_agreeing_windows():
    assert decontaminate.agreeing([(0, [(12, 12)]), (1, []), (2, [(12, 9)])]) == {0, 1}  # verbatim before changed
    assert decontaminate.agreeing([(0, [(12, 7)]), (1, [(12, 7)]), (2, [(12, 9)])]) == {0, 1}  # most windows first
    assert decontaminate.agreeing([(0, [(1, 2)]), (1, [(2, 1)]), (2, [(3, 2)])]) == {0, 1}


def test_decontamination_odd(spark, odd, empty):
    bench = table(spark, [(1, QUESTION)], "item_id long, text string")
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.keep_clean(odd, bench.limit(0)).count() == odd.count()


# 4 Licences -------------------------------------------------------------------------------------


def test_license_scan(spark, odd, empty):
    rows = [
        (101, "Under the MIT-License and CC  BY; mit license."),
        (102, "A GNU\nGeneral Public License! apache-license"),
        (103, "Redistribution and use in source and binary forms, with modification, are permitted provided the following conditions are met."),
        (104, "mit licenses ccby nothing"),
    ]
    docs = table(spark, rows).unionByName(odd)
    found = [r for r in licenses.scan(docs).collect()]
    assert len(found) == docs.count() and licenses.scan(empty).count() == 0
    by_id = {r.doc_id: r for r in found}
    assert (by_id[101].base_labels, by_id[101].n_base, by_id[101].first_word, by_id[101].last_word) == ("cc-by,mit", 3, 2, 7)
    assert by_id[102].base_labels == "apache,gpl" and by_id[103].base_labels == "" and "bsd" in by_id[103].labels and by_id[103].score >= 0.8
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for r in found:
        ws = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)})) for t in texts[r.doc_id]]
        assert (r.n_words, r.n_base) in [(len(w), sum(w[i : i + len(p.split())] == p.split() for p in licenses.PHRASES for i in range(len(w)))) for w in ws]


def test_license_templates_by_brute_force(spark):
    rng = np.random.default_rng(1)
    sets = [(label, set(licenses.template_words(t))) for label, t in licenses.TEMPLATES]
    rows = []
    for i in range(150):
        base = list(sets[rng.integers(len(sets))][1]) + ["alpha", "beta"]
        rows.append((i, " ".join(rng.permutation(base)[: rng.integers(1, len(base) + 1)])))
    found = {r.doc_id: set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""} for r in licenses.scan(table(spark, rows)).collect()}
    for i, text in rows:
        expected = {label for label, s in sets if len(s & set(text.split())) >= np.ceil(licenses.CONTAIN * len(s) - 1e-9)}
        assert found[i] | {"gpl", "apache", "cc-by", "mit"} == expected | {"gpl", "apache", "cc-by", "mit"}, text


WRAPPED = [
    ("bsd", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"),
    ("isc", "# Permission to use, copy, modify, and/or distribute this software for any\r\n# purpose with or without fee is hereby granted, provided that\r\n"),
    ("mpl-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n"),
]


def test_wrapped_license_notices(spark):
    rows = [(i, "word " * before + "\n" + text + "more " * 70) for i, (_, text) in enumerate(WRAPPED) for before in (0, 1, 40, 51, 52, 53, 103, 104, 150)]
    rows += [(100 + i, text.replace(" ", " filler " * 12)) for i, (_, text) in enumerate(WRAPPED)]  # words of a notice far apart on several lines
    for r in licenses.scan(table(spark, rows)).collect():
        assert (r.labels, r.score) == ((WRAPPED[r.doc_id][0], 1.0) if r.doc_id < 100 else ("", 0.0)), r


def test_wrapped_license_templates_by_brute_force(spark):
    rng = np.random.default_rng(2)
    sets = [(label, set(licenses.template_words(t)), 2 * len(re.findall("[A-Za-z0-9]+", t))) for label, t in licenses.TEMPLATES]
    rows = []
    for i in range(150):
        base = re.findall("[a-z0-9]+", licenses.TEMPLATES[rng.integers(len(sets))][1].lower())
        base = [w for w in base if rng.random() > 0.1] + ["alpha"] * rng.integers(0, 20)
        base = list(rng.permutation(base)) if rng.random() < 0.5 else base
        rows.append((i, "".join(w + rng.choice(["\n", " "]) for w in ["x"] * rng.integers(120) + base + ["y"] * rng.integers(120))))
    found = {r.doc_id: (set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""}, r.score, r.n_base) for r in licenses.scan(table(spark, rows)).collect()}
    base = {"gpl", "apache", "cc-by", "mit"}
    for i, text in rows:
        ws, expected, best = text.split(), set(), 0
        blocks = [(line.split(), 10**9) for line in text.split("\n")]
        for label, s, width in sets:
            most = max(len(s & set(b[:w])) for b, w in [*blocks, *((ws[k : k + width], width) for k in range(len(ws)))])
            if most >= np.ceil(licenses.CONTAIN * len(s) - 1e-9):
                expected, best = expected | {label}, max(best, most / len(s))
        assert found[i][0] | base == expected | base and found[i][1] == (1 if found[i][2] else best), text


# 5 Mixing ---------------------------------------------------------------------------------------


def test_mixing_matches_sql_on_odd_rows(odd):
    documents = odd.toPandas()[["doc_id", "text", "lang", "source"]].astype(object)
    documents = documents.where(documents.notna(), None)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", documents.values.tolist())
    shown = lambda rows: sorted(map(repr, rows))
    expected = con.execute(f"select doc_id, domain, lang, source, n_tokens, copies from ({mixing.ORACLE})").fetchall()
    assert shown(tuple(r) for r in mixing.stage(odd).select("doc_id", "domain", "lang", "source", "n_tokens", "copies").collect()) == shown(expected)


def test_mixing_empty(empty):
    assert mixing.stage(empty).count() == 0


def test_mixing_shortage_goes_to_siblings(spark):
    leaves = table(spark, [("d0", "en", "a", 10, 1), ("d0", "en", "b", 1000, 1), ("d1", "en", "c", 1000, 1)], "domain string, lang string, source string, tokens long, rows long")
    found = {r.source: r.budget for r in mixing.budgets(leaves, F.lit(400), {}, 1).collect()}
    assert found == {"a": 10, "b": 190, "c": 200}  # a's shortage stays in its domain


# 6 Toxicity -------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    rows = toxicity.op6_toxicity(spark, d).filter("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    good, bad = rows.score[rows.toxic == 0].to_numpy(), rows.score[rows.toxic == 1].to_numpy()
    auc = (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2
    assert auc > 0.9 and (good < 0.5).mean() > 0.95


def test_toxicity_spots_the_sentence(spark):
    calm = ["The river is calm today", "We walk to the market", "Bread costs little here"]
    docs = [(i, ". ".join([calm[i % 3], calm[(i + 1) % 3], *(["You zorg grumble vile"] if i % 4 == 0 else [])])) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    found = toxicity.score(table(spark, docs), toxicity.train(table(spark, docs), table(spark, labels, "doc_id long, toxic int"))).collect()
    assert all((r.tox_score >= 0.5) == (r.doc_id % 4 == 0) for r in found)
    bad = next(r for r in found if r.doc_id == 0)
    assert [bad.text[s.start : s.end] for s in bad.tox_sentences] == ["You zorg grumble vile"]


def test_toxicity_of_long_texts(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    clean = [r.text for r in toxicity.score(docs, model).filter("tox_score < 0.1 and length(text) > 200").orderBy("doc_id").limit(20).collect()]
    neutral = " ".join(f"Qx{i % 97} zq{i % 101} kj{i % 103}." for i in range(60_000))  # no sentence twice
    rows = [(i, (t + "\n") * (1_000_000 // len(t) + 1)) for i, t in enumerate(clean)] + [(100, neutral)]
    assert len(clean) == 20 and all(r.tox_score < 0.5 for r in toxicity.score(table(spark, rows), model).collect())


def test_toxicity_learns_from_long_texts(spark):
    calm = "The river is calm today. We walk to the market. " * 500
    docs = [(i, calm + ("You zorg grumble vile. " if i % 2 else "") + calm) for i in range(60)]
    labels = table(spark, [(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    found = toxicity.score(table(spark, docs), toxicity.train(table(spark, docs), labels)).collect()
    assert all((r.tox_score >= 0.5) == (r.doc_id % 2 == 1) for r in found)


def test_toxicity_odd(spark, odd, empty):
    none = table(spark, [], "doc_id long, toxic int")
    assert [r.tox_score for r in toxicity.score(odd, toxicity.train(odd, none)).collect()] == [0.0] * odd.count()
    assert toxicity.keep_clean(empty, none).count() == 0


# 7 Near-duplicates ------------------------------------------------------------------------------


def brute_components(rows, k, p, q):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if sets[i] and sets[j] and q * common_ >= p * (len(sets[i]) + len(sets[j]) - common_):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(s), repr(least.get(find(i), d))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def families(seed, many):
    """Families of copies with a few words changed, around each threshold, and one group too large for plain pairs."""
    rng = np.random.default_rng(seed)
    rows = []
    for size in (2, 5, 20, many):
        base = [f"w{rng.integers(500)}" for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.integers(0, 7)):
                copy[rng.integers(120)] = f"v{rng.integers(50)}"
            rows.append((int(rng.integers(1 << 40)), " ".join(copy)))
    return rows + [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "two words"), (None, "two words"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "many", "k", "p"), [(0, 60, 3, 85), (1, 60, 5, 80), (2, 330, 3, 85)])
def test_near_duplicates_by_brute_force(spark, seed, many, k, p):
    rows = families(seed, many)
    found = near_dedup.near_duplicates(table(spark, rows), k, (p, 100)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in found) == brute_components(rows, k, p, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


def test_near_duplicates_odd(odd, empty):
    assert near_dedup.near_duplicates(odd).count() == odd.count() and near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (5, 6, 7)").count() == 1


def test_pipeline_stage_links_at_080_on_five_words(spark):
    base = [f"w{i}" for i in range(200)]
    block = [f"b{i}" for i in range(45)]
    edited = [f"e{i}" if i % 40 == 7 else f"q{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base + block)), (3, " ".join(f"q{i}" for i in range(200))), (4, " ".join(edited))]
    kept = corpus_pipeline._near_dedup(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]  # a block added: 196 of 241; scattered edits: 171 of 221


def test_stages_know_rows_by_id_and_text(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (None, text("c")), (None, text("C")), (None, text("d")), (5, text("e")), (5, text("E")), (5, text("e")), (7, None), (None, None), (1, text("f"))]
    kept = near_dedup.one_of_each(table(spark, rows)).collect()
    assert sorted((repr(r.doc_id), (r.text or "").lower()[:1]) for r in kept) == [("1", "a"), ("1", "f"), ("2", "b"), ("5", "e"), ("7", ""), ("None", ""), ("None", "c"), ("None", "d")]
    bench = table(spark, [(1, QUESTION)], "item_id long, text string")
    left = decontaminate.keep_clean(table(spark, [(None, QUESTION), (None, text("a")), (3, QUESTION), (3, text("b")), (4, None)]), bench).collect()
    assert sorted((repr(r.doc_id), (r.text or "")[:1]) for r in left) == [("3", "b"), ("4", ""), ("None", "a")]


def test_bands_follow_the_threshold():
    assert near_dedup.bands_for((85, 100)) == 16
    assert all((1 - (p / 100) ** near_dedup.ROWS) ** near_dedup.bands_for((p, 100)) <= near_dedup.MISS for p in (50, 80, 85, 90, 99))


# 8 Quality --------------------------------------------------------------------------------------


def test_quality(spark, odd, empty):
    rows = [(i, f"word{i % 7} and more words", "en", "good" if i % 2 else "bad") for i in range(400)]
    labels = table(spark, [(i, int(i % 2 if i % 10 else 1 - i % 2)) for i in range(400)], "doc_id long, quality int")
    docs = table(spark, [*rows, (1000, "word1 and more words", "en", "unseen")])
    found = {r.doc_id: r for r in quality.score(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert found[1].score > found[1000].score > found[2].score  # an unseen site stands at the global prior
    none = labels.limit(0)
    assert {r.doc_score for r in quality.score(odd, none, F.col("source"), F.col("lang")).collect()} == {0.5}
    assert quality.score(empty, labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.score(odd, labels, F.col("source"), F.col("lang")).count() == odd.count()


def test_quality_shrinks_sparse_sites_more(spark):
    labels = table(spark, [(i, int(i < 300)) for i in range(600)], "doc_id long, quality int")
    rows = [(i, "same text", "en", "large" if i < 200 else f"s{i}" if i < 300 else f"t{i // 50}") for i in range(600)]
    found = {r.doc_id: r.host_rate for r in quality.score(table(spark, rows), labels, F.col("source"), F.col("lang")).collect()}
    assert found[0] > found[250] > 0.5


# 9 Personal data --------------------------------------------------------------------------------


def luhn(v):
    digits = [int(c) for c in reversed(v) if c.isdigit()]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def brute_base(t):
    n = lambda v: sum(c.isdigit() for c in v)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= n(v) <= 19 and luhn(v)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= n(v) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans_by_brute_force(spark, odd):
    rng = np.random.default_rng(5)
    parts = ["a@b.c", "x@y", "@", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "++1 23 45 67 89 01", " ", "-", ".", "é\U0001f600", "12345", "a.b@c-d.e.f", "%+", "00255.0.0.1"]
    rows = [(i, "".join(rng.choice(parts, rng.integers(1, 12)))) for i in range(600)]
    docs = table(spark, rows).unionByName(odd.filter("length(text) < 1000 or text is null"))
    found = docs.select("text", pii._written(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    for r in found:
        assert r.s == brute_base(r.text or ""), r.text


def test_bootstrapping_finds_unseen_identifiers(spark, tmp_path):
    rows = [(i, f"Hello. The password: hunter{i:04d}xy stands here") for i in range(30)] + [(100 + i, f"badge= QX{i:04d}77Z") for i in range(3)] + [(200, "The year 1999 and route 66 are plain")]
    table(spark, rows).write.parquet(str(tmp_path / "d"))
    found = {r.doc_id: r for r in pii.find(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert all(len(found[i].found) == 1 for i in range(30)) and not found[200].found


def test_redaction(odd, empty):
    kept = pii.redact(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert kept.filter("doc_id = 11").first().text == "Mail [EMAIL] or [PHONE] now."
    assert kept.filter("doc_id = 8").first().text == LONG and pii.redact(empty).count() == 0


# 10 URL lists -----------------------------------------------------------------------------------


def test_entries_hold_from_add_to_remove(spark):
    events = table(spark, [("block", "a.org", "add", "2024-01-01"), ("block", "a.org", "remove", "2024-02-01"), ("block", "a.org", "add", "2024-03-01"), ("allow", "a.org/x", "add", "2024-01-01"), ("block", None, "add", "2024-01-01"), ("block", "a.org", "add", "2024-01-01")], "verdict string, value string, action string, day string")
    captures = table(spark, [(1, "https://www.A.org/y", "2024-01-01"), (2, "https://www.a.org/y", "2024-02-01"), (3, "https://www.a.org/y", "2029-02-01"), (4, "https://a.org/x/z?q", "2024-01-05"), (5, None, "2024-01-05"), (6, "odd", "2024-01-05"), (7, "https://a.org", None), (1, "https://www.A.org/y", "2024-01-01"), (8, "https://a.org", "2023-12-31")], "page_id long, url string, fetched string, row int, span int")
    found = sorted((r.page_id, r.verdict, r.rule) for r in url_lists.judge(captures, events).collect())
    assert found == [(1, "block", "a.org"), (1, "block", "a.org"), (2, "none", None), (3, "block", "a.org"), (4, "allow", "a.org/x"), (5, "none", None), (6, "none", None), (7, "none", None), (8, "none", None)]
    assert url_lists.judge(captures.limit(0), events).count() == 0
    assert url_lists.judge(captures, events.limit(0)).filter("verdict <> 'none'").count() == 0


def test_entries_of_deep_paths(spark):
    deep = "a.org/" + "/".join(f"s{i}" for i in range(12))
    events = table(spark, [("block", deep, "add", "2024-01-01")], "verdict string, value string, action string, day string")
    captures = table(spark, [(1, f"https://{deep}/more?q", "2024-01-05"), (2, f"https://{deep[:-4]}", "2024-01-05")], "page_id long, url string, fetched string")
    assert sorted((r.page_id, r.verdict, r.rule) for r in url_lists.judge(captures, events).collect()) == [(1, "block", deep), (2, "none", None)]


# Round trips and brute force of what SQL cannot express ------------------------------------------


def test_media_member_that_fails_is_read_again(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * 50) for i in range(9)]
    folder = f"file://{tmp_path}/m"
    media.write(table(spark, rows).coalesce(1), folder).collect()
    reader, plain, asked = media.ArchiveReader({"path": folder}), media.zipfile.ZipFile.read, []

    def lost(self, info, *more):
        asked.append(info.header_offset)
        if len(asked) in (4, 5):
            raise OSError("lost")
        return plain(self, info, *more)

    monkeypatch.setattr(media.zipfile.ZipFile, "read", lost)
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["doc_id"], media.decode(r["media"])[0]) for r in found] == [(i, len(t)) for i, t in rows]
    assert len(asked) == 11 and asked[3] == asked[4] == asked[5] and sorted(set(asked)) == [r["offset"] for r in found]


def broken_archive(spark, tmp_path, change):
    folder = tmp_path / "w"
    warc.write(table(spark, [(i, None, f"<p>{i} " + "".join(chr(97 + (i * j) % 26) for j in range(900))) for i in range(8)], PAGES).coalesce(1), f"file://{folder}").collect()
    (path,) = folder.glob("*.warc.zst")
    raw = bytearray(path.read_bytes())
    starts = [r.position for r in warc.read(spark, f"file://{folder}").orderBy("position").collect()]
    path.write_bytes(change(raw, starts))
    return f"file://{folder}"


@pytest.mark.parametrize(("at", "good"), [(lambda s: s[3] + 40, 7), (lambda s: s[3], 7), (lambda s: s[3] + 8, 7), (lambda s: s[0] + 1, 7), (lambda s: s[7] + 30, 7)])
def test_warc_reads_on_after_a_broken_frame(spark, tmp_path, at, good):
    def flip(raw, starts):
        raw[at(starts)] ^= 0x5A
        return bytes(raw)

    folder = broken_archive(spark, tmp_path, flip)
    rows = warc.read(spark, folder, strict="false").collect()
    assert sum(r.error is None for r in rows) == good and sum(r.error is not None for r in rows) == 1
    with pytest.raises(Exception, match="frame at|at "):
        warc.read(spark, folder).collect()


def test_warc_cut_off_and_without_dictionary(spark, tmp_path):
    rows = warc.read(spark, broken_archive(spark, tmp_path / "a", lambda raw, s: bytes(raw[: s[6] + 25])), strict="false").collect()
    assert [r.error is None for r in sorted(rows, key=lambda r: r.position)] == [True] * 6 + [False]
    (row,) = warc.read(spark, broken_archive(spark, tmp_path / "b", lambda raw, s: bytes(raw[s[0] :])), strict="false").collect()
    assert row.error == "no dictionary frame" and row.page_id is None


def test_warc_with_many_repeated_payloads_shuffles_only_those(spark, monkeypatch):
    rows = [(i, None, f"<p>{i // 2 if i < 60 else i} " + "z" * 1200) for i in range(100)] + [(None, None, "<p>0 " + "z" * 1200)]
    shown = lambda: sorted((r.page_id or -1, r.digest, r.response or -1) for r in warc.classify(table(spark, rows, PAGES)).collect())
    few = shown()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    assert shown() == few and sum(r[2] >= 0 for r in few) == 30


def brute_words(text):
    """(canonical word, value of a placeholder) of each word and where sentences begin, before names there are known."""
    tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"(?:[0-9A-Za-z]|[^\x00-\x7f]|(?<=[0-9])[.,](?=[0-9]))+", text or "")]
    out = []
    for i, (w, a, _) in enumerate(tokens):
        low = "".join(c.lower() if c < "\u00df" else c for c in w)
        begins = i == 0 or bool(re.search(r"[.!?:\n]", text[tokens[i - 1][2] : a]))
        kind = "<num>" if re.match("[0-9]", w) else "<unit>" if out and out[-1][0] == "<num>" and low in decontaminate.UNITS else "<name>" if re.match("[A-Z\u00c0-\u00d6\u00d8-\u00de][a-z\x80-\U0010ffff]", w) else None
        out.append((kind, low, w, begins))
    return out


def brute_windows(text, plain):
    """(canonical window, slot values by place) of each window of a text, by position, and its words as a whole; plain words and sets."""
    words_ = []
    for kind, low, _, begins in brute_words(text):
        kind = None if kind == "<name>" and begins and low in plain else kind
        words_.append((kind or low, low if kind else None, low))
    out = {}
    for i in range(len(words_) - 4):
        part = words_[i : i + 5]
        if sum(v is None for _, v, _ in part) >= 3:
            out[i] = (tuple(c for c, _, _ in part), [v for _, v, _ in part if v is not None])
    return out, words_


def brute_contaminated(docs, items):
    plain = {low for _, question in items for m in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", question) for low in [m] if not re.match("[A-Z\u00c0-\u00d6\u00d8-\u00de]", m)}
    plain = {"".join(c.lower() if c < "\u00df" else c for c in w) for w in plain}
    found = {}
    for d, text in docs:
        own, words_ = brute_windows(text, plain)
        for item, question in items:
            asked, whole = brute_windows(question, plain)
            kept = set()
            for offset in {i - j for i in own for j in asked}:
                met = [(j, list(zip(asked[j][1], own[j + offset][1], strict=True))) for j in asked if j + offset in own and own[j + offset][0] == asked[j][0]]
                kept |= decontaminate.agreeing(met)
            if asked and len(kept) >= decontaminate.COVER * len(asked):
                found[d, item] = max(len(kept), found.get((d, item), 0))
            if not asked and len(whole) >= 4:
                for i in range(len(words_) - len(whole) + 1):
                    part = words_[i : i + len(whole)]
                    same = [x[0] for x in part] == [x[0] for x in whole] and sum(v is None for _, v, _ in whole) >= 3
                    if [x[2] for x in part] == [x[2] for x in whole] or (same and decontaminate.agreeing([(0, [(a[1], b[1]) for a, b in zip(whole, part, strict=True) if a[1] is not None])])):
                        found[d, item] = 1
    return found


def test_decontamination_by_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(12)] + ["12", "3.5", "km", "hours", "Bob", "Rome"]
    make = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    items = [(i, make(rng.integers(7, 30))) for i in range(12)] + [(0, make(20)), (20, "frame words stand in all of the items here 5"), (21, "frame words stand in all of the items here 7")]
    docs = []
    for i in range(80):
        text = items[rng.integers(len(items))][1].split()
        for _ in range(rng.integers(0, 4)):
            text[rng.integers(len(text))] = str(rng.choice(vocabulary))
        docs.append((int(rng.integers(40)), f"{make(rng.integers(0, 9))} {' '.join(text)} {make(rng.integers(0, 9))} 12"))
    docs += [(90, "Km frame words stand in all of the items here 9")] * 2
    found = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.contaminated(table(spark, docs), table(spark, items, "item_id long, text string")).collect()}
    expected = brute_contaminated(docs, items)
    assert set(found) == set(expected) and len(found) > 20 and all(found[k] <= expected[k] for k in found)


def test_names_that_begin_sentences_and_short_items(spark):
    maria = "Maria bought 12 red apples at the market. Maria ate 3 of them. How many apples were left in her basket at the end?"
    elise = "\u00c9lise counted 40 grey stones near the river. Later \u00c9lise gave 15 of these away to some friends who lived there."
    items = [(1, maria), (2, "Solve 3x + 5 = 20 for x."), (3, "Why is water wet?"), (4, elise), (5, "two words"), (6, "1, 2, 3, 5, 8, 13 and 21")]
    changed = maria.replace("12", "31").replace(" 3 ", " 9 ")
    docs = [
        (1, changed), (2, changed.replace("Maria", "Peter")), (3, maria.replace("Maria", "Peter")), (4, "So: " + maria.replace("Maria", "Zo\u00eb") + " Well."), (5, "Please solve 3x + 5 = 20 for x and show each step."), (6, "Please solve 4x + 9 = 31 for x and show each step."),
        (7, "Tell me: why is water wet? Nobody knows."), (8, "Why is grass wet in the morning when no rain has come down on it at all"), (9, elise.replace("\u00c9lise", "\u00c5sa").replace("40", "70")), (10, "These two words stand in clean text."), (11, "1, 2, 3, 5, 8, 13 and 21 are told"), (12, "2, 3, 4, 6, 9, 14 and 22 are told"), (13, maria.replace("Maria ate", "Peter ate")),
    ]
    found = {(r.doc_id, r.item_id): r.changed for r in decontaminate.contaminated(table(spark, docs), table(spark, items, "item_id long, text string")).collect()}
    assert set(found) == set(brute_contaminated(docs, items))
    assert {k: v for k, v in found.items() if k[0] != 13} == {(1, 1): True, (2, 1): True, (3, 1): True, (4, 1): True, (5, 2): False, (7, 3): False, (9, 4): True, (11, 6): False}


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    half = len(QUESTION) // 2
    rows = [(7, QUESTION[:half]), (7, QUESTION[half:]), (8, QUESTION), (None, QUESTION)]
    found = decontaminate.contaminated(table(spark, rows), table(spark, [(1, QUESTION)], "item_id long, text string")).collect()
    assert sorted(repr(r.doc_id) for r in found) == ["8", "None"]


def beta_binomial(groups, least=1.0, most=1e4):
    """Strength of groups (n, k, prior rate) by the second moment."""
    s, e, x = (sum(f(n, k, m) for n, k, m in groups) for f in (lambda n, k, m: (k - n * m) ** 2, lambda n, k, m: n * m * (1 - m), lambda n, k, m: n * (n - 1) * m * (1 - m)))
    return most if x <= 0 or s <= e else min(max(x / (s - e) - 1, least), most)


def test_quality_posterior_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        host = f"h{min(int(rng.exponential(6)), 40)}.example"
        rows.append((i, f"Some text {i} " * int(rng.integers(1, 20)), None, host, None, None, f"{host}/{rng.integers(3)}"))
    labels = [(i, int(rng.random() < (0.2 if hash(rows[i][3]) % 3 == 0 else 0.8))) for i in range(600)]
    found = quality.score(table(spark, rows), table(spark, labels, "doc_id long, quality int"), F.col("source"), F.col("key")).collect()
    y = dict(labels)
    count = lambda key: {g: (sum(key(r) == g for r in rows[:600]), sum(y[r[0]] for r in rows[:600] if key(r) == g)) for g in {key(r) for r in rows[:600]}}
    hosts, paths = count(lambda r: r[3]), count(lambda r: (r[3], r[6]))
    rate = (sum(y.values()) + 1) / 602
    strong = beta_binomial([(n, k, rate) for n, k in hosts.values()])
    host_rate = {h: (k + strong * rate) / (n + strong) for h, (n, k) in hosts.items()}
    strong_path = beta_binomial([(n, k, host_rate[h]) for (h, _), (n, k) in paths.items()])
    path_rate = {p: (k + strong_path * host_rate[p[0]]) / (n + strong_path) for p, (n, k) in paths.items()}
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    site = {r[0]: (r[3], r[6]) for r in rows}
    for r in found:
        h, p = site[r.doc_id]
        own = path_rate.get((h, p), host_rate.get(h, rate))
        assert r.host_rate == pytest.approx(host_rate.get(h, rate)) and r.path_rate == pytest.approx(own)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(logit(r.doc_score) - logit(rate) + logit(own)))))


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scores = quality.score(spark.read.parquet(f"{d}/documents.parquet"), labels.filter(~fold), F.col("source"), F.col("lang"))
    rows = scores.join(labels.filter(fold), "doc_id").select("score", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert len(bad) > 50 and (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2 > 0.9


def hexed(i, n=40):
    return hashlib.sha512(str(i).encode()).hexdigest()[:n]


def spans_of(spark, rows, rounds=pii.ROUNDS):
    path = common.scratch(spark, "texts")
    table(spark, rows).write.parquet(path)
    return {r.doc_id: [(s.start, s.end) for s in r.found] for r in pii.find(spark.read.parquet(path), rounds).collect()}


def test_patterns_of_seeds_find_identifiers_of_other_forms(spark):
    """Badges of a credential's form teach the context; it finds badges of a new form; and that form finds them in a new context."""
    rows = [(i, f'so the badge = "{hexed(i)}" was') for i in range(120)]
    rows += [(1000 + i, f'so the badge = "QX-{1000 + i}-{i}77Z" was') for i in range(20)]  # unseen form
    rows += [(200 + i, f"we met gate: QX-{2000 + i}-{i}11Z today") for i in range(2)]  # unseen context
    rows += [(300 + i, f"the year {1900 + i} and chapter 12345678{i} are plain, as is route66a{i}bcd") for i in range(9)]
    found = {r: spans_of(spark, rows, r) for r in (0, 1, 3)}
    hits = {r: {i for i, spans in f.items() if spans} for r, f in found.items()}
    assert hits[0] == set(range(120)) and hits[1] == hits[0] | set(range(1000, 1020)) and hits[3] == hits[1] | {200, 201}
    text = dict(rows)
    assert all(text[i][a:b].startswith("QX-") for i in range(1000, 1020) for a, b in found[3][i])


def test_graph_scores_by_brute_force(spark):
    rng = np.random.default_rng(6)
    groups = {}
    for _ in range(120):
        key = (str(rng.choice(["token", "badge", "gate", "", "year"])), str(rng.choice(['="', ": ", " "])), f"form{rng.integers(9)}")
        n = int(rng.integers(1, 30))
        groups[key] = (int(rng.integers(0, n + 1)) if rng.random() < 0.5 else n if rng.random() < 0.5 else 0, n)
    graph = spark.createDataFrame([(*k, *v) for k, v in groups.items()], "word string, signs string, form string, p long, n long")
    found = {(r.word, r.signs, r.form): r.conf for r in pii.scored(graph, 3).collect()}
    conf = {k: p / n for k, (p, n) in groups.items()}
    context = lambda k: (k[0], k[1]) if k[0] and re.search(pii.ASSIGNS, k[1]) else None
    for _ in range(3):
        means = []
        for part in (context, lambda k: k[2]):
            sums = {}
            for k, (_, n) in groups.items():
                if part(k) is not None:
                    a, b = sums.get(part(k), (0, 0))
                    sums[part(k)] = (a + conf[k] * n, b + n)
            means.append({g: a / (b + pii.PRIOR) for g, (a, b) in sums.items() if b >= pii.SUPPORT})
        both = {k: 1 - (1 - means[0].get(context(k), 0)) * (1 - means[1].get(k[2], 0)) for k in groups}
        conf = {k: max(conf[k], both[k] if both[k] >= pii.ACCEPT else 0) for k in groups}
    assert found == pytest.approx(conf)


def test_many_mentions_in_one_text(spark):
    n = 100_000
    text = " ".join(f"id{i % 7}=ab{i:07d}x bob{i}@x.org 1.2.3.{i % 300}" for i in range(n))
    path = common.scratch(spark, "texts")
    table(spark, [(1, text)]).write.parquet(path)
    (r,) = pii.redact(spark.read.parquet(path)).collect()
    parts = re.split(r"\[(EMAIL|IP)\]", r.text)
    assert parts[1::2].count("EMAIL") == n and parts[1::2].count("IP") == sum(i % 300 < 256 for i in range(n))
    assert r.text.startswith("id0=ab0000000x [EMAIL] [IP] id1=")


def test_running_folds_equal_plain_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [int(x) for x in rng.integers(-9, 9, n)]) for i, n in enumerate((0, 1, 31, 32, 33, 1000, 1056, 40_000))]
    d = spark.createDataFrame(rows, "i int, v array<int>").withColumn("sum", pii.running(F.col("v"), F.lit(0), lambda x, y: x + y)).withColumn("max", pii.running(F.col("v"), F.lit(None).cast("int"), F.greatest))
    for r in d.collect():
        assert r["sum"] == np.cumsum(r.v).tolist() and r["max"] == (np.maximum.accumulate(r.v).tolist() if r.v else [])


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        common.shared_folder(Cluster)
