"""A training-data pipeline of the operators in callmeter.llm: toxic documents go, one document of each group of near
copies stays, contaminated documents go, personal data are replaced, and the rest is mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callmeter.llm import decontaminate, mixing, near_dedup, pii, toxicity
from callmeter.llm.common import cut


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, 5, (80, 100))


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("decontamination", _decontamination), ("pii", _pii), ("mixing", _mixing)]
#: Toxicity is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
