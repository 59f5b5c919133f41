"""What several operators share: scratch tables in the shared folder, checked broadcasts, bounded
bit sets, word hashing over Arrow batches, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import kept, passing, remove, scratch, shared_folder
from ..scratch import written as cut

__all__ = ["cut", "kept", "passing", "scratch", "shared_folder"]

#: Rows and bytes of values up to which a written side is broadcast; beyond either, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20
#: Bits of a bounded bit set (2 MB); a fuller one lets more rows through and stays right.
BITS = 1 << 24
#: UTF-8 bytes of text that the numpy helpers handle at a time.
SLICE_BYTES = 1 << 20


def _value_bytes(schema: T.StructType) -> Column:
    """Bytes of a row's values: the contents of strings and arrays, and 16 for each column."""
    size = F.lit(16 * len(schema))
    for f in schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            size = size + 64 * F.greatest(F.size(f.name), F.lit(0))
    return size


def measured(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """As cut(), with the numbers of rows and of their values' bytes, taken while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_value_bytes(df.schema)), F.lit(0)).alias("bytes")), name)
    return table, seen.get["n"], seen.get["bytes"]


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As cut(), and the number of rows, counted while they are written."""
    return measured(df, name)[:2]


def small_cut(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """As cut(); marked for broadcast if it has at most `rows` rows and `most` bytes of values; else Spark shuffles."""
    table, n, held = measured(df, name)
    return F.broadcast(table) if n <= rows and held <= most else table


def with_columns(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; a missing one is null. Extra columns go, so no name can clash."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in needed.items()])


#: Columns of documents: no function uses these names for anything else.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def beside(*own: str) -> Callable:
    """For a function (docs, ...) -> DataFrame that works on the columns `own` of docs: docs' other columns, but for DOCUMENT's, are one struct
    meanwhile, so whatever they are called, they meet no name of the function's. They come back as they were, in docs' order, before columns that the function adds (which
    take the place of columns of the same name)."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def run(docs: DataFrame, *args, **named) -> DataFrame:
            others = [c for c in docs.columns if c not in own and c not in DOCUMENT]
            if not others:
                return f(docs, *args, **named)
            quoted = lambda c: "`" + c.replace("`", "``") + "`"
            held = docs.select(*[c for c in docs.columns if c not in others], F.struct(*[F.col(quoted(c)) for c in others]).alias("_beside"))
            out = f(held, *args, **named)
            new = [c for c in out.columns if c not in held.columns]
            return out.select(*[F.col("_beside")[c].alias(c) if c in others else F.col(c) for c in docs.columns if c not in new], *new)

        return run

    return around


def bit_set(keys: DataFrame, column: str) -> bytes:
    """A bit set of BITS bits with the bits of a long column's values on; its size does not grow with the data."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()  # at most BITS / 32768 rows
    out = bytearray(BITS // 8 + 4096)
    for r in rows:
        at = (r.b - 1) * 4096 if r.b else BITS // 8
        out[at : at + 4096] = r.m
    return bytes(out)


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys have their bit on in a bit_set() seen as uint8."""
    k = keys % BITS  # numpy's % is pmod here
    k = np.where(k == 0, (BITS // 8) * 8, k - 1)  # Spark's bucket 0 holds the value 0, bucket 1 the values 1 to 32768
    return (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1


# Words and shingles -----------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse; the largest so far is kept."""
    if not _CACHE or max(_CACHE) < n:
        up, down = np.full(n, _ODD), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _CACHE.clear()
        _CACHE[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return next(iter(_CACHE.values()))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end) of data: a polynomial over mixed bytes, then mixed with the length."""
    n = 1 << max(12, int(len(data)).bit_length())
    up, down = _powers(n)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8, null as empty) for runs of rows of about SLICE_BYTES, whole texts always."""
    first, held, n = 0, [], 0
    for i, x in enumerate(texts.cast(pa.large_binary())):
        b = x.as_py() or b""
        held.append(b)
        n += len(b)
        if n >= SLICE_BYTES:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles: words [^\\x20\\x09-\\x0D]+ of the text
    with A-Z lower-cased; fewer than k words are one shingle, none are an empty set."""
    for _, held in text_slices(texts):
        data = LOWER[np.frombuffer(b"\n".join(held), np.uint8)]
        starts, ends = spans(~SPACE[data])
        words = word_hashes(data, starts, ends)
        bounds = np.cumsum([0] + [len(b) + 1 for b in held])
        first = np.searchsorted(starts, bounds)
        grams = shingled(words, k)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield np.array([shingled(words[a:b], int(b - a))[0] ^ np.uint64(b - a)])
            else:
                yield np.empty(0, np.uint64)


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + words[j : j + n]) * np.uint64(0xD6E8FEB86659FD93 + 2 * j)
        out ^= out >> np.uint64(32)
    return mix(out)


# Graphs -----------------------------------------------------------------------------------------


#: Edges that a task joins into a forest at a time.
FOREST_EDGES = 1 << 18


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges (u, v), sorted, and the smallest node that each reaches over them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) that connect what the given ones connect: (node, root) of the components of runs of about `most` edges in a task, roots with themselves.
    Up to `most` edges in one task are one run."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0
        told = lambda nodes, roots: pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["u", "v"])
        for batch in batches:
            us.append(batch.column("u").to_numpy())
            vs.append(batch.column("v").to_numpy())
            held += batch.num_rows
            if held > most:
                nodes, roots = _roots(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [nodes], [roots], len(nodes)
                if held > most // 2:  # else the forest so far takes more edges
                    yield told(nodes, roots)
                    us, vs, held = [], [], 0
        if held:
            yield told(*_roots(np.concatenate(us), np.concatenate(vs)))

    return edges.mapInArrow(join, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node that it reaches.
    Each task first joins its edges into forests of bounded size. If that is more than one, large and small stars follow in turn;
    every round's edges are a scratch table, and hubs are joins that Spark can split."""
    given, n = counted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"), "edges")
    table = cut(_forests(given.coalesce(1 + n // FOREST_EDGES), FOREST_EDGES), "edges")
    remove(given)
    if n <= FOREST_EDGES:
        return table.select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = table.filter("u <> v")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, table = table, cut(small_star, "edges")
        remove(before)
        e = table
        # done when the edges are stars: each node has one root, and no root has one
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("x"), F.lit(1 << 20).alias("n")).distinct())
        if ends.groupBy("x").agg(F.sum("n").alias("n")).filter(f"n > 1 and n <> {1 << 20}").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
