"""Token stores: plain encoding by the library, the files' bytes, the hash index, keyed reads, and odd rows."""

import glob
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callmeter.llm import token_index as T

SCHEMA = "doc_id long, text string, key string, h long, part string, shard long, ids string, row int"


@pytest.fixture(scope="module")
def model():
    return T.tokenizer_json()


def plain(model, texts):
    return [[*e.ids, 1] for e in Tokenizer.from_str(model).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3) for r in rows], SCHEMA)


def test_words_once_gives_what_the_library_gives(model, monkeypatch):
    monkeypatch.setattr(T, "HELD_WORDS", 200)  # forgets on the way
    rnd = random.Random(6)
    letters = "ÀÉßÿ×÷üabcXYZ019 '\"!-_<|>\n\t\x1c\x0b\x00éΣσ中文́  \u0085İſﬁ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|>a <|endoftext|> don't I'LL he'S", "x<|startoftext|>", "ΑΣ ΑΣ. Σ", "é e ́", "", " "]
    encoder = T.Encoder(model)
    assert encoder.pattern is not None
    found = [i.tolist() for at in range(0, len(texts), 500) for i in encoder.encode([t.encode() for t in texts[at : at + 500]])]
    assert found == [ids[:-1] for ids in plain(model, texts)]


def test_other_tokenizers_are_given_whole_texts(spark, tmp_path):
    model = T.tokenizer_json("byte_bpe_50k.json")
    assert T.Encoder(model).pattern is None
    texts = ["Two  spaces and\nlines", None, "é"]
    T.write(frame(spark, enumerate(texts)), f"file://{tmp_path}", model, 50256)
    expected = [[*e.ids, 50256] for e in Tokenizer.from_str(model).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [T.Store(f"file://{tmp_path}").get(i)[0].tolist() for i in range(3)] == expected


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_minimal_perfect_hash(n):
    hashes = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    records = np.zeros(n, T.RECORD)
    records["fingerprint"] = T._fingerprint(hashes)
    data = T.Part.pack(hashes, records)
    part = T.Part(data[: T.Part.head_bytes(n)])
    assert sorted(part.slots(hashes)) == list(range(n))
    stored = np.frombuffer(data, T.RECORD, n, part.records_at)
    assert (stored["fingerprint"][part.slots(hashes)] == T._fingerprint(hashes)).all()
    others = np.arange(1000, dtype=np.uint64)
    slots = part.slots(others)
    assert not n or not (stored["fingerprint"][slots] == T._fingerprint(others))[slots >= 0].any()
    assert part.records_at <= T.Part.head_bytes(n)


def test_equal_hashes_are_an_error():
    with pytest.raises(ValueError):
        T.build_hash(np.array([5, 5], np.uint64))


def test_store(spark, tmp_path, model, monkeypatch):
    """Nulls, repeated rows and keys over many shards: payload bytes in order of keys, and every document by its key."""
    monkeypatch.setattr(T, "PART_KEYS", 20)
    monkeypatch.setattr(T, "READ_BYTES", 64)
    monkeypatch.setattr(T, "SHARD_BYTES", 500)
    rnd = random.Random(1)
    text = lambda: rnd.choice([None, "", "one", "One two, three!", "x " * 500, " ".join(rnd.choice(["ab", "cd", "Ef"]) for _ in range(rnd.randint(0, 60)))])
    rows = [(rnd.choice([None, 7, -3, rnd.randint(-(10**12), 10**12), rnd.randint(0, 40)]), text()) for _ in range(400)]
    rows += [(7, f"hot {i % 5}") for i in range(200)] + [rows[0]] * 3
    folder = f"file://{tmp_path}"
    manifest = T.write(frame(spark, rows), folder, model)
    ids = [np.array(i) for i in plain(model, [t for _, t in rows])]
    hashes = [r.h for r in spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "i int, text string").select("i", F.xxhash64("text").alias("h")).orderBy("i").collect()]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, hashes[i]))
    payload = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{tmp_path}/ids-*.bin")))
    assert payload == b"".join(ids[i].astype("<u2").tobytes() for i in order) and len(manifest["shards"]) > 3
    store = T.Store(folder)
    for key in {k for k, _ in rows}:
        assert [x.tolist() for x in store.get(key)] == [ids[i].tolist() for i in order if rows[i][0] == key]
    assert store.get(10**15) == [] and store.get(41) == []
    starts = np.cumsum([0, *(len(ids[i]) for i in order)])
    expected = sorted(repr((rows[i][0], int(s), len(ids[i]), zlib.crc32(ids[i].astype("<u4").tobytes()))) for s, i in zip(starts, order, strict=False))
    keys = spark.createDataFrame([(k,) for k in [*{k for k, _ in rows}, 7, 10**15]], "key long")
    assert sorted(map(repr, map(tuple, T.checksums(keys, folder).collect()))) == expected
    some = T.read(spark.createDataFrame([(-3,)], "key long"), folder).orderBy("start").collect()
    assert [r.ids for r in some] == [ids[i].tolist() for i in order if rows[i][0] == -3]
    assert not [f for f in glob.glob(f"{tmp_path}/*") if "/_" in f] and json.load(open(f"{tmp_path}/manifest.json"))["width"] == 2


def test_no_rows(spark, tmp_path, model):
    manifest = T.write(frame(spark, []), f"file://{tmp_path}", model)
    assert manifest["shards"] == [] and T.Store(f"file://{tmp_path}").get(None) == []
    assert T.checksums(spark.createDataFrame([(1,)], "key long"), f"file://{tmp_path}").collect() == []


def test_query_rows(spark, model):
    from callmeter.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    start, expected = 0, {}
    for (doc_id, _), ids in zip(docs, plain(model, [t for _, t in docs]), strict=True):
        expected[doc_id] = (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = QUERIES["op12_token_index"](spark, sf)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r.doc_id: tuple(r) for r in found.collect()} == expected
