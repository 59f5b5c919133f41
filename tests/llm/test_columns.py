"""Documents whose other columns have the names that stages use themselves; tasks without this package."""

import os
import re
import subprocess
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callmeter.llm import common

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def internal_names():
    """Every name that the stages' modules give to a column, by their text."""
    found = set()
    for name in ("common", "near_dedup", "decontaminate", "pii", "mixing", "toxicity"):
        text = (ROOT / f"callmeter/llm/{name}.py").read_text()
        found |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed)\((?:[^()"]*, )?"(\w+)"', text)) | set(re.findall(r'"(_\w+|\w+_id|\w+_hash)"', text))
    return sorted((found | {"others", "_beside", "tox_score", "tox_sentences", "leaf", "near_id", "bad_hash", "a.b", "c`d"}) - set(OWN) - {"domain", "n_tokens", "copies"})


def test_stages_keep_columns_of_any_name(spark):
    names = internal_names()
    assert len(names) > 40
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = common.cut(docs.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(n) for i, n in enumerate(names)]), "named")
    plain = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs, plain = common.cut(stage(spark, docs, DIR), name), common.cut(stage(spark, plain, DIR), f"{name}-plain")
        assert docs.columns[: len(OWN) + len(names)] == [*OWN, *names] and set(docs.columns) - set(names) == set(plain.columns)
        wrong = " or ".join(f"`{n.replace('`', '``')}` <> concat('{i}:', cast(doc_id as string))" for i, n in enumerate(names))
        assert docs.filter(wrong).count() == 0
        assert sorted(map(repr, docs.select(plain.columns).collect())) == sorted(map(repr, plain.collect())), name


@pytest.mark.parametrize("query", ["op6_toxicity"])
def test_tasks_need_no_copy_of_the_package(query):
    """From another folder, with workers that cannot import it."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()[{query!r}](spark, {DIR!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    told = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=300, check=False)
    assert "rows 200" in told.stdout, told.stderr[-2000:]
