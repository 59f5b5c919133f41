"""Quality by hierarchical empirical Bayes: a document's own evidence, shrunk site rates as its prior.

Evidence: a logistic classifier over character and word ratios, fitted by Newton steps on a documented bounded sample of
at most TRAIN_ROWS labelled rows (features only, never texts). Prior: the rate of good labels of the document's path,
shrunk toward its host's, which is shrunk toward the global rate. How strongly is estimated from the data at each level by
moments of a beta-binomial, from grouped counts over all labelled rows. The score is the
posterior: logit(score) = logit(classifier) - logit(global) + logit(path). All labels given are learned from; whoever
measures on held-out rows leaves their labels out.

Defined results: null and empty texts have ratios 0 and are scored; null hosts and paths are one of their own; labels
of 0 and 1 count, a document labelled more than once has its smallest, one with several texts stands in the sample with that of
the smallest hash; without both classes the score is the prior alone (0.5 without labels); repeated rows score alike; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_cut, with_columns

TRAIN_ROWS, STRENGTH = 20_000, (1.0, 1e4)


def evidence(text: Column) -> list[Column]:
    """Ratios to the number of characters or words, and the logarithm of the length."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(t, r"\s+")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return [count("[A-Z]") / n, count(r"[!?|]") / n, count(r"[#$%&*=_<>{}\[\]~^\\/+]") / n, count("[0-9]") / n, count(r"\n") / n, F.size(F.array_distinct(words)) / F.size(words), n / F.size(words) / 20.0, F.log10(n) / 5.0]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of standardised columns and a bias, as [bias, weights..., means..., scales...]."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penal = ridge * np.r_[0, np.ones(len(w) - 1)]
        w += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penal + 1e-9), z.T @ (y - p) - penal * w)
    return np.concatenate([w, mean, scale])


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, prior: str) -> float:
    """Beta-binomial strength of groups(n, k) around each one's prior rate: how many labels the prior is worth."""
    m = F.col(prior)
    r = groups.agg(F.sum("n").alias("n"), F.sum(F.pow(F.col("k") - F.col("n") * m, 2)).alias("s"), F.sum(F.col("n") * m * (1 - m)).alias("e"), F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("x")).first()
    # E[(k - n m)^2] = n m (1 - m) (1 + (n - 1) / (strength + 1))
    if not r.n or r.x <= 0 or r.s <= r.e:
        return STRENGTH[1]
    return float(np.clip(r.x / (r.s - r.e) - 1, *STRENGTH))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, doc_score, host_rate, path_rate, score, keep) for each row of docs(doc_id, text, ...)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    labels = with_columns(labels, {"doc_id": "long", "quality": "int"}).filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    labels = small_cut(labels, "labels")
    known = rows.select("doc_id", "host", "path").join(labels, "doc_id")
    paths = cut(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = (total.k + 1) / (total.n + 2) if total.n else 0.5
    hosts = hosts.withColumn("global", F.lit(rate))
    strong = _strength(hosts, "global")
    hosts = hosts.select("host", ((F.col("k") + strong * rate) / (F.col("n") + strong)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    strong_path = _strength(paths, "host_rate")
    paths = paths.select("host", "path", ((F.col("k") + strong_path * F.col("host_rate")) / (F.col("n") + strong_path)).alias("path_rate"))
    site_paths, site_hosts = small_cut(paths, "path_rates"), small_cut(hosts, "host_rates")

    x = F.array(*evidence(F.col("text")))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    sample = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", x.alias("x"), F.xxhash64("text").alias("at"))
    sample = sample.groupBy("doc_id", "y").agg(F.min_by("x", "at").alias("x")).toPandas().sort_values("doc_id")  # a row for each chosen document
    doc = F.lit(rate)
    if len(sample) and sample["y"].nunique() == 2:
        model = fit(np.stack(sample["x"].to_numpy()), sample["y"].to_numpy())
        d = (len(model) - 1) // 3
        z = F.lit(float(model[0]))
        for i in range(d):
            z = z + (F.col("x")[i] - float(model[1 + d + i])) / float(model[1 + 2 * d + i]) * float(model[1 + i])
        doc = 1 / (1 + F.exp(-z))
    found = rows.withColumn("x", x).withColumn("doc_score", doc).select("doc_id", "host", "path", "doc_score")
    found = found.join(site_hosts, "host", "left").join(site_paths, ["host", "path"], "left").withColumn("host_rate", F.coalesce("host_rate", F.lit(rate))).withColumn("path_rate", F.coalesce("path_rate", "host_rate"))
    post = 1 / (1 + F.exp(-(_logit(F.col("doc_score")) - _logit(F.lit(rate)) + _logit(F.col("path_rate")))))
    return found.withColumn("score", post).select("doc_id", "doc_score", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table's site is its source; a path is a language of it."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))
