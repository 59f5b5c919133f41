"""Benchmark decontamination by template canonicalisation.

Words are runs of letters, digits and non-ASCII bytes. A number becomes <num>, a unit after a number <unit>, a
capitalised word inside a sentence <name>, and so does one that begins a sentence, unless the benchmark has that word without a capital somewhere
(capitals are A-Z and those of Latin-1); other words are lower-cased. Windows of WINDOW canonical words with at least
LITERALS words that are not placeholders are hash-joined with those of the benchmark. An item without such a window is compared as
a whole: its words as they stand and, if LITERALS of them are no placeholders, its canonical words. Within one alignment (document,
item, offset) the placeholders are judged slot by slot: a value that stands verbatim always counts; of the changed ones each
value of the item has one value in the document and the other way round, those of the most windows first. Windows with a
slot that conflicts with this are left out, the others stay. Thus a copy with other numbers or names is caught, and
unrelated texts that share a frame are not. A document is contaminated by an item if the windows that stay cover at least
COVER of the item's windows.

A bounded bit set of the benchmark's window hashes lets tasks pass on only windows that can join, so the join does not
shuffle the corpus; a benchmark of any size stays right, as the join decides. Texts are known by their hashes, so each row is judged by
its own text alone. A text that COVER of an item's n windows stand in holds one of its n - ceil(COVER n) + 1 rarest: only these
look for candidates, and whole items are then compared with their candidates. So a window that many items and texts share
does not pair them all.

Defined results: null and empty texts match nothing; an item of fewer than SHORTEST words
is matched by nothing; repeated rows and repeated ids give one row for each doc_id and item_id, that of the text and item of most
coverage; null ids take part; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, beside, bit_set, cut, in_bits, mix, shingled, small_cut, spans, text_slices, with_columns, word_hashes

WINDOW, LITERALS, COVER, SHORTEST = 5, 3, 0.8, 4
#: Units that may follow a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars cent cents euro euros pound pounds percent degree degrees kmh mph hz khz mhz ghz b kb mb gb tb w kw kwh v a pa kpa j kj cal kcal".split()

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_TOKEN = _DIGIT.copy()
_TOKEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?:\n")] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,")] = True
_NUM, _UNIT, _NAME = np.uint64(1), np.uint64(2), np.uint64(3)


def _one(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return word_hashes(data, np.array([0]), np.array([len(data)]))[0]


_UNIT_HASHES = np.sort(np.array([_one(u) for u in UNITS], np.uint64))


def _lowered(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 with A-Z and the capitals of Latin-1 lower-cased, and whether each byte begins such a capital."""
    out, capital = LOWER[raw], (raw >= 65) & (raw <= 90)
    wide = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[1:][wide] += 0x20
    capital[:-1] |= wide
    return out, capital


def templates(held: list[bytes], plain: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: each word's canonical hash, its value hash, whether it is a placeholder, and the first word of each text. plain: a bit set of
    the words that are no names where they begin a sentence; without it none of those is a name."""
    raw = np.frombuffer(b"\n".join(held), np.uint8)
    digit = _DIGIT[raw]
    inside = _TOKEN[raw]
    inside[1:-1] |= _POINT[raw[1:-1]] & digit[:-2] & digit[2:]
    starts, ends = spans(inside)
    bounds = np.cumsum([0] + [len(b) + 1 for b in held])
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool), first
    low, capital = _lowered(raw)
    words = word_hashes(low, starts, ends)
    number = digit[starts]
    after = np.concatenate(([False], number[:-1]))
    after[first[:-1][first[:-1] < len(starts)]] = False  # a text's first word follows no number
    unit = after & np.isin(words, _UNIT_HASHES)
    ended = np.concatenate(([0], np.cumsum(_END[raw])))
    begins = np.concatenate(([True], ended[starts[1:]] > ended[ends[:-1]]))
    begins[first[:-1][first[:-1] < len(starts)]] = True
    second = raw[np.minimum(starts + 1 + (raw[starts] == 0xC3), len(raw) - 1)]
    small = ((second >= 97) & (second <= 122)) | (second >= 128)
    name = capital[starts] & small & (ends - starts > 1 + (raw[starts] == 0xC3))
    name &= ~begins if plain is None else ~begins | ~in_bits(plain, words.view(np.int64))
    canonical = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, words)))
    return canonical, words, number | unit | name, first


def plain_words(texts: DataFrame) -> bytes:
    """A bit set of the words that texts(text) have without a capital."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, held in text_slices(batch.column("text")):
                raw = np.frombuffer(b"\n".join(held), np.uint8)
                starts, ends = spans(_TOKEN[raw])
                low, capital = _lowered(raw)
                found = np.unique(word_hashes(low, starts, ends)[~capital[starts]])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return bit_set(texts.select("text").mapInArrow(run, "h long").distinct(), "h")


def _whole(canonical: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of `length` consecutive canonical words, or, if it is below zero, of as many words as they stand."""
    return (shingled(canonical if length > 0 else words, abs(length)) ^ mix(np.array([length], np.int64).view(np.uint64))).view(np.int64)


def windows(texts: DataFrame, key: str, plain: bytes, bits: bytes | None = None, lengths: list[int] | None = None) -> DataFrame:
    """(key, pos, h, slots, of, length): windows of each text; of: how many the text has; length: WINDOW, or that of a whole item without a window (below
    zero: its words as they stand). Without bits texts are items; with them only windows whose bit is on come, also those of the given
    lengths of items."""
    spark = texts.sparkSession.sparkContext
    shared = spark.broadcast((plain, bits))  # two bit sets of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, on = (None if b is None else np.frombuffer(b, np.uint8) for b in shared.value)
        for batch in batches:
            keys = batch.column(key)

            def told(row: int, owner: np.ndarray, pos: np.ndarray, h: np.ndarray, slots: list, of: np.ndarray, length: int, keys: pa.Array = keys) -> pa.RecordBatch:
                n = len(owner)
                return pa.RecordBatch.from_arrays([keys.take(pa.array(owner + row)), pa.array(pos, pa.int64()), pa.array(h), pa.array(slots, pa.list_(pa.int64())), pa.array(of, pa.int64()), pa.array([length] * n, pa.int64())], [key, "pos", "h", "slots", "of", "length"])

            for row, held in text_slices(batch.column("text")):
                canonical, values, slot, first = templates(held, names)
                size, of = np.diff(first), np.zeros(len(held), np.int64)
                filled = lambda i, n, values=values, slot=slot: values[i : i + n][slot[i : i + n]].view(np.int64)
                n = len(canonical) - WINDOW + 1
                if n > 0:
                    h = shingled(canonical, WINDOW).view(np.int64)
                    slots = np.convolve(slot, np.ones(WINDOW, int), "valid")
                    owner = np.searchsorted(first, np.arange(n), side="right") - 1
                    ok = (np.arange(n) + WINDOW <= first[owner + 1]) & (WINDOW - slots >= LITERALS)
                    of = np.bincount(owner[ok], minlength=len(held))
                    at = np.flatnonzero(ok & in_bits(on, h) if on is not None else ok)
                    if len(at):
                        yield told(row, owner[at], at - first[owner[at]], h[at], [filled(i, WINDOW) if slots[i] else [] for i in at], of[owner[at]], WINDOW)
                if on is None:
                    for i in np.flatnonzero((of == 0) & (size >= SHORTEST)):
                        a, b = first[i], first[i + 1]
                        for length in (int(a - b), int(b - a)) if (~slot[a:b]).sum() >= LITERALS else (int(a - b),):
                            yield told(row, np.array([i]), np.array([0]), _whole(canonical[a:b], values[a:b], length), [filled(a, b - a) if length > 0 else []], np.array([1]), length)
                for length in lengths or []:
                    h = _whole(canonical, values, length)
                    owner = np.searchsorted(first, np.arange(len(h)), side="right") - 1
                    at = np.flatnonzero((np.arange(len(h)) + abs(length) <= first[owner + 1]) & in_bits(on, h)) if len(h) else []
                    if len(at):
                        yield told(row, owner[at], at - first[owner[at]], h[at], [filled(i, length) if length > 0 else [] for i in at], of[owner[at]], length)

    return texts.select(key, "text").mapInArrow(run, f"{key} long, pos long, h long, slots array<long>, of long, length long")


def agreeing(found: list[tuple[int, list[tuple[int, int]]]]) -> set[int]:
    """Positions of the windows (position, (item value, document value) of each slot) of one alignment whose slots agree."""
    seen: dict[tuple[int, int], set[int]] = {}
    for pos, slots in found:
        for pair in slots:
            seen.setdefault(pair, set()).add(pos)
    there, back = {}, {}
    for item, doc in sorted(seen, key=lambda p: (p[0] != p[1], -len(seen[p]), min(seen[p]), p)):
        if item not in there and doc not in back:
            there[item], back[doc] = doc, item
    return {pos for pos, slots in found if all(there.get(item) == doc for item, doc in slots)}


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = [sorted(agreeing([(w["item_pos"], list(zip(w["item_slots"], w["slots"], strict=True))) for w in found.as_py()])) for found in batch.column("found")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("text_hash", "item", "of", "changed")), pa.array(at, pa.list_(pa.int64()))], ["text_hash", "item", "of", "changed", "at"])


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_hash, item_id, n_windows, coverage, changed) of the texts of docs(text) and the items of benchmark(item_id, text)."""
    bench = with_columns(benchmark, {"item_id": "long", "text": "string"}).filter("text is not null").distinct()
    item = F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    named = bench.withColumn("item", item)
    plain = plain_words(bench)
    items = small_cut(windows(named, "item", plain).select("item", "h", "of", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "length"), "items")
    lengths = sorted(r.length for r in items.filter(F.col("length") != WINDOW).select("length").distinct().collect())  # distinct lengths of short items
    texts = with_columns(docs, {"text": "string"}).withColumn("text_hash", F.xxhash64("text"))
    found = cut(windows(texts, "text_hash", plain, bit_set(items, "h"), lengths).drop("of", "length").distinct(), "found")

    often = items.join(found.groupBy("h").agg(F.count("*").alias("n")), "h", "left")
    rarest = F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "h", "item_pos"))  # an item's windows are those of its one text
    rare = often.withColumn("rank", rarest).filter(F.col("n").isNotNull() & ((F.col("rank") <= F.col("of") - F.ceil(COVER * F.col("of") - 1e-9) + 1) | (F.col("length") != WINDOW)))  # a whole item has two forms
    candidates = found.select("text_hash", "h").join(rare.select("item", "h").distinct(), "h").select("text_hash", "item").distinct()

    met = found.join(candidates.join(items, "item"), ["text_hash", "h"]).withColumn("offset", F.col("pos") - F.col("item_pos"))
    differs = F.col("item_slots") != F.col("slots")
    aligned = met.groupBy("text_hash", "item", "offset", "of").agg(F.collect_set(F.struct("item_pos", "item_slots", "slots")).alias("found"), F.max(differs).alias("changed"))
    judged = aligned.select("text_hash", "item", "of", "changed", "found").mapInArrow(_judged, "text_hash long, item long, of long, changed boolean, at array<long>")
    whole = judged.select("text_hash", "item", "of", "changed", F.explode("at").alias("at")).groupBy("text_hash", "item", "of").agg(F.count_distinct("at").alias("n_windows"), F.max("changed").alias("changed"))
    kept = whole.filter(F.col("n_windows") >= F.ceil(COVER * F.col("of") - 1e-9)).join(named.select("item", "item_id"), "item")
    return kept.select("text_hash", "item_id", "n_windows", (F.col("n_windows") / F.col("of")).alias("coverage"), "changed")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, changed): changed if a number, unit or name differs from the item's."""
    found = small_cut(contaminated_texts(docs, benchmark), "contaminated")
    rows = with_columns(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.xxhash64("text").alias("text_hash")).join(found, "text_hash")
    most = F.max(F.struct("coverage", "n_windows", "changed")).alias("most")
    return rows.groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", "most.n_windows", "most.coverage", "most.changed")


@beside("text")
def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents. A document is judged by its text alone, known by its hash, whatever its doc_id."""
    found = contaminated_texts(docs.select("text"), benchmark)
    bad = small_cut(found.select(F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(F.col("text").cast("string")) == F.col("bad_hash"), "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
