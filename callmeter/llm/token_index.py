"""Token ids in raw binary shards, and a minimal perfect hash index over the documents' keys.

A store is a folder. `ids-<shard>.bin` holds nothing but ids, little-endian, 2 bytes each where the vocabulary fits and else 4, of documents in
ascending order of their keys, shard after shard; `len-<shard>.bin` holds the documents' numbers of ids, 8 bytes each.
`index-<part>.mph` maps keys to places: keys are dealt into parts by their hash, and a part of n keys has a minimal perfect hash (levels of
bits, each key at the first level where it is alone on its bit; its slot is the number of bits before that one) and n records of a fixed
size, in order of slots: the key's fingerprint, shard, document number and offset in the shard, and number of documents. `manifest.json` has the width, the
end id, and each shard's and part's sizes; it is written last, so a store without it is none.

A lookup hashes the key to its part, probes the levels, and reads one record and then the documents' lengths and ids at their offsets: a fixed number
of positioned reads however many keys there are. The hash of a 64-bit key has an inverse, and the fingerprint is this hash mixed, so
other keys are never taken for a key that is there; a key that is not there is found missing.

Writing: texts are sorted into shards by ranges of (key, hash of the text, row), so a key of most of the rows is many shards; a shard's task encodes
and writes it, once. A key's documents stand together, in shards that follow each other; its record names the first and
their number. Reading by keys deals lookups by part, then pieces of at most a shard by shard, so both are bounded.

Defined results: a null or empty text is the end id alone; a null key is a key of its own, before all others, in a part of its own; repeated keys are
documents of the same key in order of their texts' hashes; no rows make a store without shards; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, measured, mix, scratch, with_columns

END = 1
#: Bytes of text that a shard is made for; keys of a part of the index, and parts at most (beyond, parts grow).
SHARD_BYTES, PART_KEYS, PARTS = 128 << 20, 1 << 14, 1 << 16
#: Bits a key in each level; levels after which keys must have been equal.
GAMMA, LEVELS = 2, 200
#: Words whose ids an encoder holds before it starts anew, and bytes that a reader takes at a time.
HELD_WORDS, READ_BYTES = 400_000, 4 << 20
RECORD = np.dtype([("fingerprint", "<u8"), ("shard", "<i8"), ("document", "<i8"), ("offset", "<i8"), ("documents", "<i8")])


# Encoding -----------------------------------------------------------------------------------------

_PLAIN = re.compile("[!-~\u00c0-\u00ff]+")
_LETTERS = [chr(c) for c in range(33, 256) if chr(c).isalpha() and _PLAIN.fullmatch(chr(c))]


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for; new ones are kept in `new`."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, with add_special_tokens=False. Where its parts show that tokens never span white space
    (it is dropped) and that words are only normalised to NFC and lower-cased, words are encoded once each and remembered; those of printable ASCII and
    Latin-1 letters, which NFC leaves alone, from the pieces of the tokenizer's own pattern by its model."""

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, parts = Tokenizer.from_str(model), json.loads(model)
        self.model, self.pattern = self.tokenizer.model, self._pattern(parts)
        marks = [t["content"] for t in parts["added_tokens"]]
        self.marks, self.begins = re.compile("|".join(map(re.escape, marks)) or "(?!)"), re.compile("[" + re.escape("".join({m[0] for m in marks})) + "]" if marks else "(?!)")
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        # whether letters are one piece: of the pattern's alternatives only "letters" begins with one
        choices = self.pattern.pattern.split("|") if self.pattern else []
        self.letters = [c for c in choices if any(regex.match(c, x) for x in _LETTERS)] == [r"[\p{L}]+"]
        self._forget()

    def _forget(self) -> None:
        """words: the number of each word; its ids are self.ids[self.starts[number] : self.starts[number + 1]]."""
        self.words, self.pieces = _Numbers(), {}
        self.ids, self.starts = array("i"), array("q", [0])

    @staticmethod
    def _pattern(parts: dict) -> regex.Pattern | None:
        steps = (parts["normalizer"] or {}).get("normalizers", [])
        splits = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
        alone = [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["add_prefix_space"] and not splits[1]["use_regex"]
        drops = alone and not regex.search(splits[0]["pattern"]["Regex"], " \t\n\r\v\f")
        spaced = any(regex.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"])
        return regex.compile(splits[0]["pattern"]["Regex"]) if plain and drops and not spaced and parts["model"]["type"] == "BPE" and not parts["post_processor"] else None

    def _whole(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 4096):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False))

    def _piece(self, piece: str) -> list[int]:
        seen = piece if piece.isascii() else self.byte_level.pre_tokenize_str(piece)[0][0]  # printable ASCII is its own byte-level form
        found = self.pieces[piece] = [t.id for t in self.model.tokenize(seen)]
        return found

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of words, which have the next numbers."""
        texts, pieces, ids, starts = [w.decode() for w in words], self.pieces, self.ids, self.starts
        plain = [_PLAIN.fullmatch(s) and not (self.begins.search(s) and self.marks.search(s)) for s in texts]
        others = self._whole([s for s, p in zip(texts, plain, strict=True) if not p])
        for s, p in zip(texts, plain, strict=True):
            if not p:
                ids.extend(next(others))
            else:
                s = s.lower()
                if self.letters and s.isalpha():
                    parts = (s,)
                elif self.letters and s[:-1].isalpha() and s[-1] in ",.;:!?":
                    parts = (s[:-1], s[-1])
                else:
                    parts = self.pattern.findall(s)
                for piece in parts:
                    ids.extend(pieces.get(piece) or self._piece(piece))
            starts.append(len(ids))

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8."""
        if self.pattern is None:
            return [np.array(i, np.int64) for i in self._whole([r.decode() for r in raws])]
        if len(self.words) > HELD_WORDS:
            self._forget()
        sizes, numbers = [], []
        for r in raws:
            words = r.split()  # at \x20\x09-\x0D
            sizes.append(len(words))
            numbers.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self._learn(self.words.new)
        self.words.new = []
        number = np.concatenate(numbers)
        ids, starts = np.frombuffer(self.ids, np.int32), np.frombuffer(self.starts, np.int64)
        first, lengths = starts[number], starts[number + 1] - starts[number]
        ends = np.cumsum(lengths)
        out = ids[np.repeat(first - (ends - lengths), lengths) + np.arange(lengths.sum())]
        return np.split(out, np.concatenate(([0], ends))[np.cumsum(sizes)][:-1])


def _width(model: str, end: int) -> int:
    parts = json.loads(model)
    most = max([end, *parts["model"]["vocab"].values(), *(t["id"] for t in parts["added_tokens"])])
    return 2 if most < 1 << 16 else 4


# The index ----------------------------------------------------------------------------------------


def _position(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all levels' bits in words of 64) of a minimal perfect hash of distinct 64-bit hashes."""
    sizes, words = [], []
    while len(keys):
        if len(sizes) == LEVELS:
            raise ValueError("equal hashes in a part of the index")
        size = -(-GAMMA * len(keys) // 64) * 64
        at = _position(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        keys = keys[~alone[at]]
        sizes.append(size)
    return sizes, np.concatenate(words) if words else np.empty(0, "<u8")


class Part:
    """A part of the index: slots of hashes, from its header and bits; records are read on demand."""

    MAGIC = b"MPH1"

    def __init__(self, data: bytes) -> None:
        if data[:4] != self.MAGIC:
            raise ValueError("not a part of an index")
        levels, self.keys = (int(v) for v in np.frombuffer(data, "<u4", 2, 4))
        self.sizes = [int(v) for v in np.frombuffer(data, "<u4", levels, 12)]
        at = 12 + 4 * levels
        self.words = np.frombuffer(data, "<u8", sum(self.sizes) // 64, at)
        self.records_at = at + 8 * len(self.words)
        self.ranks = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    @classmethod
    def head_bytes(cls, keys: int) -> int:
        """Bytes within which the header and bits of a part of so many keys lie: levels shrink, in all to under 4 bits a key but for small ones."""
        return 12 + 4 * LEVELS + GAMMA * keys + 64 * LEVELS

    @classmethod
    def pack(cls, hashes: np.ndarray, records: np.ndarray) -> bytes:
        sizes, words = build_hash(hashes)
        head = cls.MAGIC + np.array([len(sizes), len(hashes), *sizes], "<u4").tobytes() + words.tobytes()
        placed = np.empty_like(records)
        placed[cls(head).slots(hashes)] = records
        return head + placed.tobytes()

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for some that are not there, any slot for others: the fingerprint tells."""
        out, left, base = np.full(len(hashes), -1), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            at = base + _position(hashes[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[on]] = (self.ranks[at >> 6] + before)[on]
            left, base = left[~on], base + size
        return out


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + np.uint64(0x632BE59BD9B4E019))


def key_hash(key: int | None) -> int:
    """Spark's xxhash64 of a long, as an unsigned number."""
    return 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)


# Writing ------------------------------------------------------------------------------------------


class _File:
    """Appears whole in the folder, by a rename."""

    def __init__(self, folder: str, name: str) -> None:
        from pyspark import TaskContext

        self.fs, path = fs.FileSystem.from_uri(folder)
        self.path, self.temporary = f"{path}/{name}", f"{path}/_{name}.{TaskContext.get().taskAttemptId()}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def _write_shards(folder: str, model: Broadcast, width: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes the texts of a shard, (key, text) in order, and writes its files; PLACE of each key in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, document, offset = TaskContext.get().partitionId(), None, 0, 0
        rows: list[list] = []  # key, shard, first document, its offset, documents, ids
        for keys, raws in _texts(batches):
            if encoder is None:
                encoder, ids, lengths = Encoder(model.value), _File(folder, f"ids-{shard:08d}.bin"), _File(folder, f"len-{shard:08d}.bin")
            found = encoder.encode(raws)
            ids.out.write(np.concatenate([x for part in found for x in (part, [end])]).astype(f"<u{width}").tobytes())
            lengths.out.write(np.array([len(part) + 1 for part in found], "<i8").tobytes())
            for key, part in zip(keys, found, strict=True):
                n = len(part) + 1
                if rows and rows[-1][0] == key:
                    rows[-1][4:] = [rows[-1][4] + 1, rows[-1][5] + n]
                else:
                    rows.append([key, shard, document, offset, 1, n])
                document, offset = document + 1, offset + n
            if len(rows) >= 100_000:
                yield _batch(rows[:-1], PLACE)
                rows = rows[-1:]
        if encoder is not None:
            ids.close()
            lengths.close()
            yield _batch(rows, PLACE)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Keys and texts as UTF-8, READ_BYTES or so at a time; whole texts always."""
    for batch in batches:
        texts, keys, raws, size = batch.column("text").cast(pa.large_binary()), [], [], 0
        for i, key in enumerate(batch.column("key").to_pylist()):
            keys.append(key)
            raws.append(texts[i].as_py() or b"")
            size += len(raws[-1])
            if size >= READ_BYTES or i == len(batch) - 1:
                yield keys, raws
                keys, raws, size = [], [], 0


PLACE = "key long, shard long, document long, offset long, documents long, ids long"


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)


def _write_parts(folder: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        hashes = table.column("h").to_numpy().astype(np.int64).view(np.uint64)
        records = np.empty(len(hashes), RECORD)
        records["fingerprint"] = _fingerprint(hashes)
        for name in ("shard", "document", "offset", "documents"):
            records[name] = table.column(name).to_numpy()
        part = table.column("part")[0].as_py()
        f = _File(folder, f"index-{part:06d}.mph")
        f.out.write(Part.pack(hashes, records))
        f.close()
        return pa.table({"part": pa.array([part], pa.int64()), "keys": pa.array([len(hashes)], pa.int64())})

    return run


def _part_of(key: str, h: str, parts: int):
    return F.when(F.col(key).isNull(), parts).otherwise(F.pmod(h, F.lit(parts))).cast("long")


def write(docs: DataFrame, folder: str, model: str, end: int = END) -> dict:
    """Writes docs(doc_id, text) as a store to the folder, with the tokenizer of which `model` is the JSON; returns the manifest."""
    spark, width = docs.sparkSession, _width(model, end)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    rows = with_columns(docs, {"doc_id": "long", "text": "string"}).select(F.col("doc_id").alias("key"), "text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    places = spark.createDataFrame([], PLACE)
    if n:
        shards = max(ceil(size / SHARD_BYTES), min(spark.sparkContext.defaultParallelism, n))
        order = ["key", "h", "row"]
        dealt = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(shards, *order).sortWithinPartitions(*order)
        places = cut(dealt.select("key", "text").mapInArrow(_write_shards(folder, spark.sparkContext.broadcast(model), width, end), PLACE), "places")  # a tokenizer's file
    told = {r.shard: (r.documents, r.ids) for r in places.groupBy("shard").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids")).collect()}  # a row for each file
    keys = places.groupBy("key").agg(F.min(F.struct("shard", "document", "offset")).alias("first"), F.sum("documents").alias("documents"))
    keys, n_keys, _ = measured(keys.select("key", F.xxhash64("key").alias("h"), "first.*", "documents"), "keys")
    parts = min(PARTS, max(1, ceil(n_keys / PART_KEYS)))
    made = keys.withColumn("part", _part_of("key", "h", parts)).groupBy("part").applyInArrow(_write_parts(folder), "part long, keys long").collect()  # likewise
    manifest = {"width": width, "end": end, "parts": parts, "keys": {str(r.part): r.keys for r in made}, "shards": [told.get(s, (0, 0)) for s in range(max(told, default=-1) + 1)]}
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_output_stream(f"{path}/manifest.json", compression=None) as out:
        out.write(json.dumps(manifest).encode())
    return manifest


# Reading ------------------------------------------------------------------------------------------


class Store:
    """Keyed access to a store, for a process of its own and for tasks."""

    def __init__(self, folder: str, manifest: dict | None = None) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        if manifest is None:
            with self.fs.open_input_stream(f"{self.path}/manifest.json", compression=None) as f:
                manifest = json.loads(f.read())
        self.width, self.parts, self.keys = manifest["width"], manifest["parts"], manifest["keys"]
        self.shards = np.array(manifest["shards"], np.int64).reshape(-1, 2)
        self.base = np.cumsum(self.shards[:, 1]) - self.shards[:, 1]
        self.held: dict[str, tuple] = {}

    def _open(self, kind: str, name: str) -> pa.NativeFile:
        """The file; the last one of each kind stays open."""
        if self.held.get(kind, ("",))[0] != name:
            if kind in self.held:
                self.held[kind][1].close()
            self.held[kind] = (name, self.fs.open_input_file(f"{self.path}/{name}"))
        return self.held[kind][1]

    def part(self, part: int) -> tuple[Part, pa.NativeFile]:
        name = f"index-{part:06d}.mph"
        f = self._open("index", name)
        if self.held.get("bits", ("",))[0] != name:
            self.held["bits"] = (name, Part(f.read_at(min(Part.head_bytes(self.keys[str(part)]), f.size()), 0)))
        return self.held["bits"][1], f

    def pieces(self, record: np.void) -> Iterator[tuple[int, int, int, int]]:
        """(shard, document, offset, documents) of a record's documents in each shard that has some."""
        shard, document, offset, left = (int(record[n]) for n in ("shard", "document", "offset", "documents"))
        while left:
            n = min(left, int(self.shards[shard, 0]) - document)
            if n:
                yield shard, document, offset, n
            shard, document, offset, left = shard + 1, 0, 0, left - n

    def documents(self, shard: int, document: int, offset: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(start in the whole store, ids) of documents that follow each other; READ_BYTES and a document are held at most."""
        lengths, ids = self._open("len", f"len-{shard:08d}.bin"), self._open("ids", f"ids-{shard:08d}.bin")
        for first in range(document, document + n, READ_BYTES // 8):
            sizes = np.frombuffer(lengths.read_at(8 * min(READ_BYTES // 8, document + n - first), 8 * first), "<i8")
            ends = np.cumsum(sizes)
            i = 0
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] - sizes[i] + READ_BYTES // self.width, "right")))
                block = np.frombuffer(ids.read_at(int(ends[j - 1] - ends[i] + sizes[i]) * self.width, offset * self.width), f"<u{self.width}")
                for part in np.split(block, ends[i : j - 1] - ends[i] + sizes[i]):
                    yield int(self.base[shard]) + offset, part
                    offset += len(part)
                i = j

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document of the key; none if it is not there."""
        h = np.array([key_hash(key)], np.uint64)
        number = self.parts if key is None else int(h.view(np.int64)[0]) % self.parts
        if str(number) not in self.keys:
            return []
        part, f = self.part(number)
        slot = int(part.slots(h)[0])
        if slot < 0:
            return []
        record = np.frombuffer(f.read_at(RECORD.itemsize, part.records_at + slot * RECORD.itemsize), RECORD)
        if record["fingerprint"][0] != _fingerprint(h)[0]:
            return []
        return [ids for piece in self.pieces(record[0]) for _, ids in self.documents(*piece)]


PIECE = "key long, shard long, document long, offset long, documents long"


def _looked_up(keys: DataFrame, folder: str, manifest) -> DataFrame:
    """PIECEs of keys(key) that the index has, each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder, manifest.value)
        for batch in batches:
            rows: list[tuple] = []
            parts, hashes = batch.column("part").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            for number in np.unique(parts).tolist():
                if str(number) not in store.keys:
                    continue
                at = np.flatnonzero(parts == number)
                part, f = store.part(number)
                records = np.frombuffer(f.read_at(part.keys * RECORD.itemsize, part.records_at), RECORD)
                slots = part.slots(hashes[at])
                here = (slots >= 0) & (records["fingerprint"][slots] == _fingerprint(hashes[at]))
                for i, slot in zip(at[here].tolist(), slots[here].tolist(), strict=True):
                    rows += [(batch.column("key")[i].as_py(), *piece) for piece in store.pieces(records[slot])]
            yield _batch(rows, PIECE)

    parts = manifest.value["parts"]
    hashed = keys.distinct().withColumn("h", F.xxhash64("key"))
    return hashed.withColumn("part", _part_of("key", "h", parts)).repartition("part").sortWithinPartitions("part").mapInArrow(run, PIECE)


def _fetched(keys: DataFrame, folder: str, describe: Callable[[np.ndarray], object], name: str, kind: pa.DataType, spark_type: str) -> DataFrame:
    """(doc_id, start, n_tokens, `name`) of each document of keys(key); describe makes the last column of ids."""
    with Store(folder).fs.open_input_stream(f"{Store(folder).path}/manifest.json", compression=None) as f:
        manifest = keys.sparkSession.sparkContext.broadcast(json.loads(f.read()))  # two numbers for each shard file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder, manifest.value)
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [kind], strict=True)], ["doc_id", "start", "n_tokens", name])

        for batch in batches:
            size = 0
            for key, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, ids in store.documents(*piece):
                    out.append((key, start, len(ids), describe(ids)))
                    size += len(ids)
                    if size >= READ_BYTES:
                        yield told()
                        out, size = [], 0
            yield told()
            out = []

    pieces = _looked_up(keys, folder, manifest).repartition("shard").sortWithinPartitions("shard", "document")
    return pieces.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {spark_type}")


def read(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document whose key is in keys(key), through the index."""
    return _fetched(keys.select(F.col("key").cast("long")), folder, lambda ids: ids.astype(np.int32), "ids", pa.list_(pa.int32()), "array<int>")


def checksums(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as read(), with the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return _fetched(keys.select(F.col("key").cast("long")), folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", pa.int64(), "long")


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """The JSON of an installed public tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op12_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "tokens")
    write(docs, folder, tokenizer_json())
    return checksums(docs.select(F.col("doc_id").alias("key")), folder)
