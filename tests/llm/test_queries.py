"""Registered queries against DuckDB, and the pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from callmeter.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    found = QUERIES[name](spark, DIR)
    cols = sorted(found.columns)
    expected = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*cols).collect()))) == sorted(map(repr, expected))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, DIR), name)
        assert 0 < docs.count() <= before or name == "mixing"
        before = docs.count()
        if name != "mixing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]


def test_pipeline_on_odd_documents(spark):
    """Null, repeated and shared ids, null and empty texts: nothing clean is lost before mixing."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    own = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").filter("length(text) > 150").orderBy("item_id").first().text
    rows = [(None, own("a"), "en", None, None), (None, own("b"), None, "src1", 9), (7, own("c"), "en", "src1", 9), (7, own("d"), "en", "src1", 9), (8, own("a"), "en", "src1", 9), (9, None, "en", "src1", 0), (10, "", "en", "src1", 0), (7, own("c"), "en", "src1", 9), (None, bench, "en", "src1", 9), (11, bench + " " + own("e"), "en", "src1", 9), (12, own("f", 20_000) + " mail a@b.org", "en", "src1", 9)]
    docs = corpus_pipeline.cut(spark.createDataFrame(rows, docs.schema), "odd")
    texts = lambda d: sorted((repr(r.doc_id), (r.text or "")[:2]) for r in d.collect())
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, DIR), name)
        found[name] = docs
    assert found["toxicity"].count() == len(rows)
    clean = [("10", ""), ("12", "f0"), ("7", "c0"), ("7", "d0"), ("8", "a0"), ("9", ""), ("None", "b0")]
    assert [r for r in texts(found["decontamination"]) if r[1] in ("", "a0", "b0", "c0", "d0", "f0")] == clean
    assert texts(found["pii"]) == texts(found["decontamination"]) and found["pii"].filter("text like '%[EMAIL]'").count() == 1
    assert set(texts(found["mixing"])) <= set(texts(found["pii"]))


def test_pipeline_on_no_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, DIR), name)
    assert docs.count() == 0
