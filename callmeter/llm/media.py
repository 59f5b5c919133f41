"""Media columns: payloads as 8-bit images in archives, and a data source that reads them back by byte ranges.

A payload is a text's UTF-8 bytes with zeros up to a positive multiple of WIDTH. Its media form is a portable graymap
(P5) WIDTH pixels wide, one byte a pixel, with the length before padding in a comment. Members are deflated into ZIP
archives of at most ARCHIVE_BYTES in a folder, one after another in each task; an archive appears whole by a rename.

The source lists the folder and plans byte ranges of the archives, from names and sizes alone. A range's reader loads the
archive's directory (at its end) and reads the members whose headers start in the range, in batches of BATCH_BYTES of
Arrow data. A member that fails (a lost connection, a checksum) is retried by its own offset up to RETRIES times, with a
newly opened file; the members before and after it are not read again.

Defined results: null and empty texts are WIDTH zeros; repeated rows are members of their own; a null doc_id comes back
null; no rows make no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .common import scratch, with_columns

WIDTH, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 64, 128 << 20, 32 << 20, 4 << 20, 3
SCHEMA = "doc_id long, archive string, offset long, media binary"


def encode(text: str | None) -> bytes:
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // WIDTH))
    return b"P5\n# %d bytes\n%d %d\n255\n" % (len(raw), WIDTH, rows) + raw + bytes(rows * WIDTH - len(raw))


def decode(media: bytes) -> tuple[int, bytes]:
    """(length before padding, samples); ValueError if it is not such a graymap."""
    magic, note, shape, depth, samples = media.split(b"\n", 4)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit graymap of its size")
    return int(note.split()[1]), samples


def feature(samples: bytes) -> str:
    """Mean, deviation, mean step between neighbours, and a histogram in eighths, in fixed decimals."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x)
    total, square = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    bins = np.bincount(x >> 5, minlength=8) * 1000 // n
    return f"{total * 1000 // n}|{(square * n - total * total) * 1000 // (n * n)}|{step * 1000 // max(1, n - 1)}|" + ",".join(map(str, bins))


def write(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the media of docs(doc_id, text) to archives in folder; (archive, members), one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        part, n, archive = TaskContext.get().partitionId(), 0, None
        out = temporary = None
        members = 0

        def done() -> pa.RecordBatch:
            archive.close()
            out.close()
            system.move(temporary, f"{path}/part-{part:06d}-{n:04d}.zip")
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:04d}.zip"]), pa.array([members], pa.int64())], ["archive", "members"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    temporary = f"{path}/_part-{part:06d}-{n:04d}.{TaskContext.get().taskAttemptId()}"
                    out = system.open_output_stream(temporary, compression=None)
                    archive, members = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1), 0
                archive.writestr(zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{members}.pgm"), encode(text.as_py()), zipfile.ZIP_DEFLATED, 1)
                members += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield done()
                    archive, n = None, n + 1
        if archive is not None:
            yield done()

    spark = docs.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "archive string, members long")


class RangePartition(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def retried(read: Callable[[], bytes], again: Callable[[], None], times: int = RETRIES) -> bytes:
    """What read() returns; after a failure again() prepares the next of `times` attempts."""
    for left in range(times, -1, -1):
        try:
            return read()
        except (OSError, zlib.error, zipfile.BadZipFile, EOFError):
            if not left:
                raise
            again()
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.range = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return [RangePartition(f.path, at, min(at + self.range, f.size)) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".zip") and not f.base_name.startswith("_") for at in range(0, f.size, self.range)]

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, RangePartition):
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        held: dict = {}

        def reopen() -> None:
            if held:
                held["file"].close()
            held["file"] = system.open_input_file(partition.path)
            held["zip"] = zipfile.ZipFile(held["file"])

        reopen()
        rows: list[tuple] = []
        size = 0
        for info in [i for i in held["zip"].infolist() if partition.start <= i.header_offset < partition.end]:
            media = retried(lambda i=info: held["zip"].read(i), reopen)  # zipfile seeks to the member's offset and checks its CRC
            name = info.filename.split("/", 1)[0]
            rows.append((None if name == "null" else int(name), partition.path, info.header_offset, media))
            size += len(media)
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, paths, offsets, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "archive", "offset", "media"])


class MediaSource(DataSource):
    """spark.read.format("media_archives").load(folder); option range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archives").options(**options).load(folder)


def features(media: DataFrame) -> DataFrame:
    """One row for each media row: what the stored bytes decode to, their digests and a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x in batch.column("media"):
                m = x.as_py()
                n, samples = decode(m)
                out.append((n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder).agg(F.sum("members")).first()  # every archive is there before they are listed
    return features(read(spark, folder))
