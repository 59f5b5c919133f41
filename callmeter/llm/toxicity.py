"""Toxicity by multiple-instance learning: a document is a bag of sentences, toxic if one of them is.

A sentence's probability is the logistic of the summed weights of its words and of their first 3 to 6 bytes
(hashed into 2^BUCKETS weights); a document's is the noisy-or of its sentences. Both the weights and the bias
come from document labels alone, by full-batch Adam on the noisy-or likelihood, over a documented bounded sample of each
class: its LONG_ROWS longest labelled texts, up to LONG_BYTES of them, and TRAIN_ROWS of the others, up to TRAIN_BYTES. Class
weights undo the sampling, so that scores follow the labelled rates. Scoring reads every whole text in Arrow batches.

When scoring, the floor (the bias, which a sentence without a suspicious word has) counts once for a document and each
sentence counts for what it has above the floor, the same words once: a text of neutral sentences scores the same whatever its
length, and a sentence said again is no new evidence.

Defined results: null and empty texts have no sentence and score 0; a document labelled more than once has its
largest label, and one text (of the smallest hash) to learn from; null labels count for nothing; without both classes every score is 0; repeated rows score alike; extra
columns are ignored; a null doc_id is scored, and its held_out is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, beside, cut, mix, spans, text_slices, with_columns, word_hashes

BUCKETS = 18
#: Of each class: rows and UTF-8 bytes of the sample.
TRAIN_ROWS, TRAIN_BYTES = 1500, 12 << 20
#: Of each class: how many of the longest texts are in the sample, and their UTF-8 bytes; a longer text than that is not learned from.
LONG_ROWS, LONG_BYTES = 50, 4 << 20
PREFIXES = (3, 4, 5, 6)
#: Standard errors by which a feature's document rates in the two classes differ at least.
APART = 4.0

_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[[*range(48, 58), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Model:
    """weights: float32 of 2^BUCKETS; bias of a sentence. Its size does not depend on the data."""

    weights: np.ndarray
    bias: float


def sentences(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: features of each word (words x features), first word of each sentence, the text of each sentence,
    and its byte range in the joined texts. A sentence is what stands between any of . ! ? and line ends."""
    data = LOWER[np.frombuffer(b"\n".join(held), np.uint8)]
    starts, ends = spans(_WORD[data])
    if not len(starts):
        none = np.empty(0, np.int64)
        return np.empty((0, 1 + len(PREFIXES)), np.int64), none, none, none, none
    hashed = [word_hashes(data, starts, np.minimum(ends, starts + n) if n else ends) + np.uint64(n) for n in (0, *PREFIXES)]
    features = np.stack([(h >> np.uint64(64 - BUCKETS)).astype(np.int32) for h in hashed], 1)
    mark = np.cumsum(_STOP[data])[starts]
    first = np.flatnonzero(np.diff(mark, prepend=-1))
    bounds = np.cumsum([0] + [len(b) + 1 for b in held])
    text = np.searchsorted(bounds, starts[first], side="right") - 1
    last = np.append(first[1:], len(starts)) - 1
    return features, first, text, starts[first], ends[last]


def _logits(model: Model, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(model.weights[features].sum(1), first) + model.bias if len(first) else np.empty(0)


def _documents(model: Model, z: np.ndarray, features: np.ndarray, first: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Scores of n texts: noisy-or of one floor and of what each sentence has above it; sentences of the same words count once."""
    floor = np.logaddexp(0, model.bias)
    over = np.logaddexp(0, z) - floor
    total = floor * (np.bincount(text, minlength=n) > 0)
    at = np.flatnonzero(over > 0)
    if len(at):
        words = mix((features.astype(np.uint64) * np.arange(1, 2 * features.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(1))
        bags = np.add.reduceat(words, first)[at]
        _, once = np.unique(np.stack([text[at].astype(np.uint64), bags], 1), axis=0, return_index=True)
        total = total + np.bincount(text[at[once]], over[at[once]], n)
    return -np.expm1(-total)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, steps: int = 80, rate: float = 0.15, shrink: float = 1e-5) -> Model:
    """Maximises the weighted noisy-or likelihood of the labels. texts: a bounded sample."""
    model = Model(np.zeros(1 << BUCKETS, np.float32), -5.0)
    if not len(texts) or labels.min() == labels.max():
        return Model(model.weights, -np.inf)
    n, n1, n0 = len(texts), (labels == 1).sum(), (labels == 0).sum()
    blocks = [range(at, min(at + 25, n)) for at in range(0, n, 25)]
    ones, zeros = np.zeros(1 << BUCKETS), np.zeros(1 << BUCKETS)  # documents of each class that have a feature
    for block in blocks:
        features, first, text, _, _ = sentences([texts[i].encode() for i in block])
        owner = text[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(features))))] if len(first) else text
        pairs = np.unique(owner.repeat(features.shape[1]).astype(np.int64) << BUCKETS | features.ravel())
        positive = labels[block.start :][pairs >> BUCKETS] == 1
        for x, held in ((ones, positive), (zeros, ~positive)):
            x += np.bincount(pairs[held] & ((1 << BUCKETS) - 1), minlength=1 << BUCKETS)
    rate_of = (ones + zeros + 1) / (n + 2)  # a feature as frequent in both classes, by a two-sample test, is left out
    apart = np.abs(ones / n1 - zeros / n0) / np.sqrt(rate_of * (1 - rate_of) * (1 / n1 + 1 / n0))
    usable = (ones + zeros >= 3) & (apart >= APART)
    flats, holders, owners, count = [], [], [], 0
    for block in blocks:
        features, first, text, _, _ = sentences([texts[i].encode() for i in block])
        if len(first):
            sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(features)))).repeat(features.shape[1])
            on = usable[features.ravel()]
            flats.append(features.ravel()[on])
            holders.append(sentence[on] + count)
            owners.append(text + block.start)
            count += len(first)
    if not count:
        return Model(model.weights, -np.inf)
    flat, held_by, text = np.concatenate(flats), np.concatenate(holders), np.concatenate(owners)
    m, v, mb, vb = np.zeros(1 << BUCKETS), np.zeros(1 << BUCKETS), 0.0, 0.0
    sums = weights.sum()
    for step in range(1, steps + 1):
        z = np.bincount(held_by, model.weights[flat], count) + model.bias
        total = np.bincount(text, np.logaddexp(0, z), n)
        pull = weights / sums * np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-9, 60)), 1.0)
        down = pull[text] / (1 + np.exp(-np.clip(z, -60, 60)))
        grad = np.bincount(flat, down[held_by], 1 << BUCKETS) + shrink * model.weights
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * down.sum(), 0.99 * vb + 0.01 * down.sum() ** 2
        slope = lambda a, b, s=step: rate * (a / (1 - 0.9**s)) / (np.sqrt(b / (1 - 0.99**s)) + 1e-6)
        model = Model((model.weights - slope(m, v)).astype(np.float32), float(model.bias - slope(mb, vb)))
    return model


def _fitting(rows: list, most_bytes: int, most_rows: int) -> set[int]:
    """The ids of rows (doc_id, n) in their order, without those that do not fit into the bytes that are left."""
    out, left = set(), most_bytes
    for r in rows:
        if r.n <= left and len(out) < most_rows:
            out.add(r.doc_id)
            left -= r.n
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels(doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0."""
    docs, labels = with_columns(docs, {"doc_id": "long", "text": "string"}), with_columns(labels, {"doc_id": "long", "toxic": "int"})
    own = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    rates = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}  # two rows
    if len(rates) < 2:
        return Model(np.zeros(1 << BUCKETS, np.float32), -np.inf)
    order = F.struct(F.xxhash64("text"), F.octet_length("text"))  # a doc_id that stands more than once is learned from by its text of the smallest hash
    sizes = docs.filter("text is not null").select("doc_id", order.alias("at")).join(own, "doc_id").groupBy("doc_id", "toxic").agg(F.min("at").alias("at")).select("doc_id", "toxic", F.col("at.col2").cast("long").alias("n"))
    sizes, chosen = cut(sizes, "sizes"), {}
    for y in (0, 1):
        part = sizes.filter(F.col("toxic") == y)
        longest = part.orderBy(F.desc("n"), "doc_id").limit(LONG_ROWS).collect()
        others = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS + LONG_ROWS).collect()
        long = _fitting(longest, LONG_BYTES, LONG_ROWS)
        chosen |= {d: (y, True) for d in long} | {d: (y, False) for d in _fitting([r for r in others if r.doc_id not in long], TRAIN_BYTES, TRAIN_ROWS)}
    if len({y for y, _ in chosen.values()}) < 2:
        return Model(np.zeros(1 << BUCKETS, np.float32), -np.inf)
    picked = docs.sparkSession.createDataFrame([(d,) for d in chosen], "doc_id long")
    rows = docs.filter("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by("text", order).alias("text")).collect()  # a row for each chosen document
    rows.sort(key=lambda r: (chosen[r.doc_id][0], r.text))  # however tasks ended, the sums are the same
    y = np.array([chosen[r.doc_id][0] for r in rows], np.int64)
    long = np.array([chosen[r.doc_id][1] for r in rows])
    # each of the longest stands for itself, the others for the rest of their class
    rest = np.array([max(0, rates[c] - (long & (y == c)).sum()) / max(1, (~long & (y == c)).sum()) for c in (0, 1)])
    weight = np.where(long, 1.0, rest[y])
    return fit([r.text for r in rows], y, weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with tox_score double and tox_sentences array<struct<start, end, score>>: the sentences of probability
    0.5 or more as code point ranges. Rows keep their order and columns; docs must have a column text."""
    held_model = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # plain values: executors need no copy of this package
    spot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held_model.value)
        for batch in batches:
            scores, spots = [], []
            for _, held in text_slices(batch.column("text")):
                features, first, text, start, end = sentences(held)
                z = _logits(model, features, first)
                scores.append(_documents(model, z, features, first, text, len(held)))
                found: list[list[dict]] = [[] for _ in held]
                at = np.cumsum([0] + [len(b) + 1 for b in held])
                for i in np.flatnonzero(z >= 0):
                    b, t = held[text[i]], text[i]
                    a, e = int(start[i] - at[t]), int(end[i] - at[t])
                    head = len(b[:a].decode("utf-8", "replace"))
                    found[t].append({"start": head, "end": head + len(b[a:e].decode("utf-8", "replace")), "score": float(1 / (1 + np.exp(-z[i])))})
                spots += found
            columns = [*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spots, pa.list_(spot))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "tox_score", "tox_sentences"])

    kept = docs.drop("tox_score", "tox_sentences")
    spans_type = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("score", "double"))
    schema = T.StructType([*kept.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_sentences", spans_type)])
    return kept.mapInArrow(run, schema)


@beside("doc_id", "text")
def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that score 0.5 or more."""
    found = score(docs, train(docs, labels))
    return found.filter("tox_score < 0.5").select(*docs.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), F.when(F.col("tox_score") >= 0.5, 1).otherwise(0).alias("predicted"), F.col("tox_sentences").alias("offending"))
