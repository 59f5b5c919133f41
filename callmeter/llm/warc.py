"""WARC archives compressed with Zstandard: a writer, and a data source that reads them back.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary, as the public WARC-with-Zstandard
convention has it; then each record is one frame. The writer trains each archive's dictionary on the archive's own first
records and starts a new archive after ARCHIVE_BYTES. The reader plans one partition for an archive, loads the dictionary,
decodes one frame for a record in a stream, and validates version, mandatory headers, Content-Length, the record's end,
and a response's HTTP length and payload digest. With strict (the default) a broken record fails the read; else it
becomes a row with its error, and reading goes on with the next frame: at the end that the broken frame's own block
sizes tell, or where these lead nowhere, at the next frame magic from which a whole frame decodes. A frame that is cut off is a
row with its error and the archive's last; an archive without its dictionary frame is one row with its error.

Equal payloads of REVISIT_BYTES or more: the row with the largest page_id is the response, the others revisit it. Digests and
lengths are grouped with partial aggregation, without the payloads. The digests of groups are broadcast if few; else a
bounded bit set of them parts the rows, and only those that may be in a group are shuffled, by a join that Spark can split.

Defined results: a null html is an empty payload; a null url becomes urn:page:<id>; rows without a page_id are
responses, without an id when read; rows repeated with the largest page_id are all responses; no rows make no archive;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import BROADCAST_BYTES, BROADCAST_ROWS, bit_set, in_bits, measured, scratch, with_columns

REVISIT_BYTES, ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 1000, 128 << 20, 16 << 10, 2 << 20
SKIPPABLE, MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: Fixed value: the profile of a revisit with an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, archive string, position long, error string"


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, response): response is the page_id of the response that a revisit refers to."""
    pages = with_columns(pages, {"page_id": "long", "url": "string", "html": "string"})
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = rows.filter(f"size >= {REVISIT_BYTES} and page_id is not null").groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).filter("top <> low").drop("low")
    groups, n, held = measured(groups, "groups")
    few = n <= BROADCAST_ROWS and held <= BROADCAST_BYTES
    groups = F.broadcast(groups) if few else groups
    shown = [F.col(c) for c in ("page_id", "url", "payload", "digest")]
    joined = lambda part: part.join(groups, ["digest", "size"], "left").select(*shown, F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("response"))
    if few:
        return joined(rows)
    key = F.xxhash64("digest", "size")
    bits = pages.sparkSession.sparkContext.broadcast(bit_set(groups.select(key.alias("key")), "key"))

    def parted(likely: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = np.frombuffer(bits.value, np.uint8)
            for batch in batches:
                yield batch.filter(pa.array(in_bits(on, batch.column("key").to_numpy(zero_copy_only=False)) == likely))

        keyed = rows.withColumn("key", key)
        return keyed.mapInArrow(run, keyed.schema)

    return joined(parted(True)).unionByName(parted(False).select(*shown, F.lit(None).cast("long").alias("response")))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    name = "null" if page_id is None else str(page_id)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if response is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """Trained on the first records; with too few to train on, the records themselves (a raw-content dictionary)."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


class Archive:
    """Writes records into <folder>/<name>; the file appears whole, by a rename, or not at all."""

    def __init__(self, folder: str, name: str, first: list[bytes]) -> None:
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.path, self.temporary = f"{path}/{name}", f"{path}/_{name}.{id(self):x}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        words = _dictionary(first)
        self.out.write(SKIPPABLE.to_bytes(4, "little") + len(words).to_bytes(4, "little") + words)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)

    def add(self, record: bytes) -> None:
        self.out.write(self.compressor.compress(record))

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of pages(page_id, url, html) to folder; returns (archive, records), one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        bytes_held, archive, records = 0, None, 0

        def done() -> pa.RecordBatch:
            archive.close()
            return pa.RecordBatch.from_arrays([pa.array([archive.path]), pa.array([records], pa.int64())], ["archive", "records"])

        def start() -> Archive:
            a = Archive(folder, f"part-{part:06d}-{n:04d}.warc.zst", held)
            for r in held:
                a.add(r)
            held.clear()
            return a

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                r = _record(*row)
                records += 1
                bytes_held += len(r)
                if archive is None:
                    held.append(r)
                    if bytes_held >= SAMPLE_BYTES:
                        archive = start()
                else:
                    archive.add(r)
                if bytes_held >= ARCHIVE_BYTES:
                    yield done()
                    archive, records, bytes_held, n = None, 0, 0, n + 1
        if held:
            archive = start()
        if archive:
            yield done()

    spark = pages.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return classify(pages).mapInArrow(run, "archive string, records long")


def _frame_end(f, at: int) -> int | None:
    """Where the frame at `at` ends by the sizes in its frame and block headers, without decoding; None if they lead past the file."""
    f.seek(at)
    head = f.read(14)
    if len(head) < 6 or head[:4] != MAGIC:
        return None
    flags = head[4]
    single = flags >> 5 & 1
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        f.seek(end)
        block = f.read(3)
        if len(block) < 3:
            return None
        told = int.from_bytes(block, "little")
        end += 3 + (1 if told >> 1 & 3 == 1 else told >> 3)
        if told & 1:
            return end + 4 * (flags >> 2 & 1)


def _frame(f, decompressor: zstandard.ZstdDecompressor, rest: bytes = b"") -> tuple[bytes, int, bytes]:
    """The decoded frame that `rest` and what f reads on begin with, its length, and what was read beyond it; ZstdError or
    ValueError if it is broken or cut off."""
    one, out, n = decompressor.decompressobj(), [], 0
    while True:
        chunk = rest or f.read(1 << 16)
        if not chunk:
            raise ValueError("cut off")
        out.append(one.decompress(chunk))
        n, rest = n + len(chunk), b""
        if one.eof:
            return b"".join(out), n - len(one.unused_data), one.unused_data


def _next_frame(f, decompressor: zstandard.ZstdDecompressor, broken: int, size: int) -> int:
    """Where reading goes on after the broken frame: its own end if a frame or the file's end stands there; else the next frame
    magic from which a frame decodes, else the file's end."""
    end = _frame_end(f, broken)
    if end is not None and end <= size:
        f.seek(end)
        if end == size or f.read(4) == MAGIC:
            return end
    at, held, start = broken + 4, b"", broken + 4
    f.seek(at)
    while chunk := f.read(1 << 20):
        held += chunk
        while (found := held.find(MAGIC)) >= 0:
            try:
                f.seek(start + found)
                _frame(f, decompressor)
                return start + found
            except (zstandard.ZstdError, ValueError):
                held, start = held[found + 4 :], start + found + 4
        held, start = held[-3:], start + max(0, len(held) - 3)
        at = start + len(held)
        f.seek(at)
    return size


def frames(f, decompressor: zstandard.ZstdDecompressor, at: int, size: int, strict: bool) -> Iterator[tuple[int, bytes | Exception]]:
    """(offset, decoded frame) one after another from offset `at` of a seekable file; only the frame at hand is held. A broken
    frame raises if strict, else its error stands in its place."""
    f.seek(at)
    rest = b""
    while at < size:
        try:
            record, n, rest = _frame(f, decompressor, rest)
        except (zstandard.ZstdError, ValueError) as e:
            if strict:
                raise ValueError(f"frame at {at}: {e}") from e
            yield at, e
            at, rest = _next_frame(f, decompressor, at, size), b""
            f.seek(at)
        else:
            yield at, record
            at += n


def parse(record: bytes) -> tuple:
    """(page_id, url, type, refers_to, digest, payload_bytes, payload) of a record; ValueError if it is not valid."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    for name in MANDATORY:
        if name.lower() not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, Content-Length {length}")
    http, sep, body = rest[:length].partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
    if not sep or not told:
        raise ValueError("no HTTP length")
    size, digest, kind = int(told[1]), fields.get("warc-payload-digest", "").removeprefix("sha1:"), fields["warc-type"]
    number = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(\d+|-\d+)>", v or "")) else None
    if kind == "response":
        if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
            raise ValueError("payload does not match its length or digest")
    elif kind != "revisit" or body or number(fields.get("warc-refers-to")) is None:
        raise ValueError(f"not a response or revisit: {kind}")
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to")), digest, size, body if kind == "response" else None


class ArchivePartition(InputPartition):
    def __init__(self, uri: str) -> None:
        super().__init__(uri)
        self.uri = uri


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.strict, self.payloads = options["path"], options.get("strict", "true").lower() == "true", options.get("payloads", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """One for each archive: a listing of file names, nothing of the records."""
        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [ArchivePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".warc.zst") and not f.base_name.startswith("_")]

    def read(self, partition: ArchivePartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, ArchivePartition):
            return
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows: list[tuple] = []
        held = 0
        for at, row, n, error in self._records(partition.uri):
            if error and self.strict:
                raise ValueError(f"{partition.uri} at {at}: {error}")
            rows.append((*row[:6], row[6] if self.payloads else None, partition.uri, at, error))
            held += n
            if held >= 8 << 20 or len(rows) >= 4096:
                yield as_batch(rows)
                rows, held = [], 0
        if rows:
            yield as_batch(rows)

    def _records(self, uri: str) -> Iterator[tuple[int, tuple, int, str | None]]:
        """(offset, parsed record or nulls, bytes held, error) for every frame after the dictionary's."""
        none = (None,) * 7
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(uri) as f:
            size = f.size()
            magic, n = (int.from_bytes(f.read(4), "little") for _ in range(2))
            if magic != SKIPPABLE or size < 8 + n:
                yield 0, none, 0, "no dictionary frame"
                return
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(n)))
            for at, record in frames(f, decompressor, 8 + n, size, self.strict):
                if isinstance(record, Exception):
                    yield at, none, 0, str(record)
                    continue
                try:
                    yield at, parse(record), len(record), None
                except ValueError as e:
                    yield at, none, len(record), str(e) or "not a record"


class WarcSource(DataSource):
    """spark.read.format("warc_zst").load(folder); options strict (true) and payloads (true)."""

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_zst").options(**options).load(folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder).agg(F.sum("records")).first()  # every archive is there before they are listed
    return read(spark, folder, payloads="false").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
t as (select *, max(page_id) over (partition by h) as top from p)
select page_id, cast(n as bigint) as payload_bytes, sha1(h) as payload_digest, case when n >= {REVISIT_BYTES} and page_id < top then 'revisit' else 'response' end as record_type, case when n >= {REVISIT_BYTES} and page_id < top then top end as refers_to from t
"""
