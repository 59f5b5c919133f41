"""Periodic runs of words: repeated stretches found by block convolutions at dyadic scales.

A run is a maximal stretch of words with smallest period q and length of at least max(LEAST, TIMES * q). A run of period q in
[B, 2B), B a power of two, holds at least two whole blocks of B words (blocks stand at multiples of B), each of which stands again
q words later. So at scale B, for each block and each distance d in [B, 2B), the sum of squared differences of the block and the B
words at that distance is found: squares by running sums, products by a number-theoretic transform of 2B residues modulo a
prime, exact in whole numbers; one transform of each block serves it, and the two blocks after it. A sum that is not zero modulo
the prime is no match, so none is missed; zeros of consecutive blocks at one distance are a seed, and the seed's stretch and a block to each
side are compared word by word, which gives the maximal stretch and rejects what was zero by chance. A stretch inside a run of a smaller
scale is that run again, with a multiple of its period, and is passed over.

The work for a document is in proportion to n log^2 n in its n words; documents of fewer than 4B words take no part in scale B. Short documents are
handled together, parted by words of their own that equal nothing. Held: the numbers of a document's words (or of SLICE_WORDS words of
short documents) and its distinct words; the text is cut into pieces, never into prefixes.

Defined results: a null or empty text, or one of white space, has no words and no run; repeated rows are rows of their own; a null doc_id comes back
null; of runs of equal length the one of the smallest start, then period, is the greatest; no rows give none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix, with_columns

LEAST, TIMES = 6, 4
SLICE_WORDS = 1 << 17
#: Primes of the transform with a generator of their units: for transforms of up to 2^16 values, and of up to 2^27.
SMALL, LARGE = (65537, 3), (2013265921, 31)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


class Transform:
    """Cyclic transforms of `size` values (a power of two) along the first axis, in whole numbers modulo a prime."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.prime, generator = SMALL if size <= SMALL[0] - 1 else LARGE
        root = pow(generator, (self.prime - 1) // size, self.prime)
        self.roots = self._powers(root, size // 2)
        self.inverse_roots = self._powers(pow(root, -1, self.prime), size // 2)
        self.scale = pow(size, -1, self.prime)
        order = np.zeros(1, np.int64)  # the order in which forward() leaves its values: bits reversed
        while len(order) < size:
            order = np.concatenate([order * 2, order * 2 + 1])
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        self.odd = (order & 1)[:, None] == 1
        self.negated = place[-order % size]

    def _powers(self, root: int, n: int) -> np.ndarray:
        out = np.ones(max(1, n), np.int64)
        step, held = root, 1
        while held < n:  # doubling: the powers so far times root^held
            out[held : 2 * held] = self.reduce(out[: min(held, n - held)] * step) % self.prime
            step, held = step * step % self.prime, 2 * held
        return out

    def reduce(self, x: np.ndarray) -> np.ndarray:
        """A number congruent to x: below 2^47 in size for x below 2^62 where the prime is SMALL, else the residue."""
        return (x & 0xFFFF) - (x >> 16) if self.prime == SMALL[0] else x % self.prime

    def forward(self, x: np.ndarray) -> np.ndarray:
        """The transform, its values in the order of reversed bits."""
        half = self.size // 2
        while half:
            x = x.reshape(-1, 2, half, x.shape[-1])
            a, b = x[:, 0], x[:, 1]
            w = self.roots[:: self.size // (2 * half)][:half, None]
            x = np.stack([self._sum(a + b), self.reduce((a - b) * w)], 1)
            half //= 2
        return self.reduce(x.reshape(self.size, -1)) % self.prime

    def backward(self, x: np.ndarray) -> np.ndarray:
        """From the order of reversed bits back; not yet divided by the size."""
        half = 1
        while half < self.size:
            x = x.reshape(-1, 2, half, x.shape[-1])
            w = self.inverse_roots[:: self.size // (2 * half)][:half, None]
            a, b = x[:, 0], self.reduce(x[:, 1] * w)
            x = np.stack([self._sum(a + b), self._sum(a - b)], 1)
            half *= 2
        return x.reshape(self.size, -1)

    def _sum(self, x: np.ndarray) -> np.ndarray:
        return x if self.prime == SMALL[0] else x % self.prime  # sums of SMALL's residues stay far below 2^46 over 16 steps


def zero_distances(x: np.ndarray, block: int, transform: Transform) -> np.ndarray:
    """(distance - block, block number) -> whether the block's squared differences from the words at that distance sum to zero modulo the
    transform's prime. x: residues, of a length that is a multiple of block; what lies beyond it is compared as zeros."""
    p, n = transform.prime, len(x) // block
    columns = np.zeros((2 * block, n + 2), np.int64)
    columns[:block, :n] = x.reshape(n, block).T
    f = transform.forward(columns)
    after = f[:, 1:-1] + np.where(transform.odd, p - f[:, 2:], f[:, 2:])  # the next two blocks, side by side
    products = transform.backward(transform.reduce(after * f[transform.negated, :-2]))[:block]
    squares = np.zeros(len(x) + 2 * block + 1, np.int64)
    np.cumsum(x * x % p, out=squares[1 : len(x) + 1])
    squares[len(x) + 1 :] = squares[len(x)]
    own = squares[block : len(x) + 1 : block] - squares[0 : len(x) : block]
    at = block * np.arange(1, n + 1) + np.arange(block)[:, None]
    there = squares[np.minimum(at + block, len(x))] - squares[np.minimum(at, len(x))]
    twice = 2 * (transform.reduce(products % p * transform.scale) % p)
    return (own + there - twice) % p == 0


def _stretches(x: np.ndarray, q: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, q) of the maximal stretches of period q in which every word from lo to hi - 1 that equals the one q later begins."""
    same = np.diff(np.concatenate(([0], (x[lo:hi] == x[lo + q : hi + q]).view(np.int8), [0])))
    for a, b in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist(), strict=True):
        if b - a + q >= max(LEAST, TIMES * q):
            yield lo + a, lo + b + q, q


def _chains(residues: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, first block, block after the last) of the zeros of consecutive blocks, where there are as many as any stretch has."""
    transform, step = Transform(2 * block), max(1, SLICE_WORDS // block)
    lags, blocks = [], []
    for lo in range(0, len(residues), step * block):
        held = residues[lo : lo + (step + 2) * block] % transform.prime
        held = np.concatenate([held, np.zeros(-len(held) % block, np.int64)])
        lag, number = np.nonzero(zero_distances(held, block, transform)[:, :step])
        lags.append(lag)
        blocks.append(number + lo // block)
    lag, number = np.concatenate(lags), np.concatenate(blocks)
    order = np.lexsort((number, lag))
    lag, number = lag[order], number[order]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(lag) != 0) | (np.diff(number) != 1)))) if len(lag) else lag
    ends = np.concatenate((begins[1:], [len(lag)]))[: len(begins)]
    distance = lag[begins] + block
    enough = ends - begins >= ((TIMES - 1) * distance - block + 1) // block
    return distance[enough], number[begins[enough]], number[ends[enough] - 1] + 1


def find_runs(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs of the word numbers x, by start, then period. bounds: where documents start, and the end; the last
    number of each document stands nowhere else."""
    found = np.empty((0, 3), np.int64)
    residues = (mix(x.astype(np.uint64) + np.uint64(1)) >> np.uint64(33)).astype(np.int64)
    lengths, block = np.diff(bounds), 1
    while (wide := lengths > max(LEAST, TIMES * block)).any():  # the last number is no word
        at = np.flatnonzero(np.repeat(wide, lengths))  # where the numbers of these documents stand
        part = x[at]
        q, first, after = _chains(residues[at], block)
        start, end = first * block, np.minimum(after * block, len(part))
        if len(found) and len(q):  # inside a run of a smaller scale: that run again
            i = np.searchsorted(found[:, 0], at[start], "right")
            reach = np.concatenate(([0], np.maximum.accumulate(found[:, 1])))[i]
            new = reach <= at[np.minimum(end + q, len(part)) - 1]
            q, start, end = q[new], start[new], end[new]
        seen = [s for d, a, b in zip(q.tolist(), start.tolist(), end.tolist(), strict=True) for s in _stretches(part, d, max(0, a - block), min(len(part) - d, b + block))]
        if seen:
            new = np.array(seen, np.int64)
            new[:, 0], new[:, 1] = at[new[:, 0]], at[new[:, 1] - 1] + 1
            every = np.unique(np.concatenate([found, new]), axis=0)  # by start, end, period: the smallest period of a stretch is first
            found = every[np.concatenate(([True], (np.diff(every[:, :2], axis=0) != 0).any(1)))]
        block *= 2
    return found[np.lexsort((found[:, 2], found[:, 0]))]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of pieces of about SLICE_BYTES, cut at white space."""
    at = 0
    while at < len(raw):
        m = _SPACE.search(raw, at + SLICE_BYTES)
        end = m.start() if m else len(raw)
        yield raw[at:end].split()  # bytes.split() parts at \x20\x09-\x0D
        at = end


def _described(doc_id: int | None, raw: bytes, n: int, runs: np.ndarray) -> tuple:
    """A row of SCHEMA; runs (start, end, period) count from the document's first word."""
    drop = np.zeros(n + 1, np.int32)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    keep, at, told = np.cumsum(drop)[:n] == 0, 0, hashlib.sha256()
    empty = True
    for words in _pieces(raw):
        kept = [w for w, k in zip(words, keep[at : at + len(words)].tolist(), strict=True) if k] if len(runs) else words
        at += len(words)
        if kept:
            told.update(b" ".join(kept) if empty else b" " + b" ".join(kept))
            empty = False
    rows = [(s, e - s, q) for s, e, q in runs.tolist()]
    lines = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in rows).encode()).hexdigest()
    top = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else (None, None, None)
    return (doc_id, len(rows), *top, 1000 * top[1] // top[2] if rows else None, lines, told.hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in rows])


def _group(held: list[tuple]) -> Iterator[tuple]:
    """Rows of SCHEMA of documents (doc_id, text as UTF-8), handled together."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    parts = []
    for _, raw in held:
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in _pieces(raw)]
        parts.append(np.array([-1]))
    x = np.concatenate(parts)
    marks = np.flatnonzero(x == -1)
    x[marks] = len(numbers) + np.arange(len(marks))
    bounds = np.concatenate(([0], marks + 1))
    runs = find_runs(x, bounds)
    split = np.searchsorted(runs[:, 0], bounds)
    for k, (doc_id, raw) in enumerate(held):
        own = runs[split[k] : split[k + 1]].copy()
        own[:, :2] -= bounds[k]
        yield _described(doc_id, raw, int(bounds[k + 1] - bounds[k] - 1), own)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text) a row of SCHEMA: its runs, the greatest of them, a digest of all, and the digest of the text
    without what repeats (words of a run after its first period; the others joined by one space)."""
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))]
    names = [part.split(" ")[0].split("<")[0] for part in SCHEMA.replace("runs array", "runs").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            texts = batch.column("text").cast(pa.large_binary())
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                raw = texts[i].as_py() or b""
                held.append((doc_id, raw))
                size += len(raw)
                if size >= SLICE_BYTES or i == len(batch) - 1:
                    columns = zip(*_group(held), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                    held, size = [], 0

    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) where a tenth of the texts, chosen by the id's checksum, repeat from some word on: with h = crc32 of the id in
    decimal, g = h div 10, n words and a = g mod n, each word from a on is word a + (i - a) mod (1 + (n - a) div (3 + g mod 8))."""
    docs = with_columns(docs, {"doc_id": "long", "text": "string"})
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10), F.size("w").cast("long")
    a = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    index = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", index(i).cast("int"))), " ")
    return a.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("runs")
