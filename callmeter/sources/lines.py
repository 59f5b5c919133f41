"""Lines with byte offsets, as a batch source and as a stream that tails growing files.

`spark.read.format("offset_lines")` cuts large files into byte ranges; a range's reader starts at the first line that begins in
it. A task reads a run of ranges, one after the other: of small ranges or files as many as make TASKS tasks of all, at least BLOCK_BYTES and at most
RANGE_BYTES. Filters on mtime and path are pushed into the listing, so files that they leave out are no partitions.

`spark.readStream` takes what has been added to files, by sizes alone: no file is opened on the driver. A line belongs to the range that its end is in, and the
range's task looks back for its beginning, so a partial last line waits. With the option `offsets` (a folder on shared storage) the stream's offset
is a number: what each micro-batch reads stands in a file of that number there, of at most max_bytes and max_files (the file whose turn it is may be
cut), and now and then a table of how far every file has been read. Without it the offset itself holds {path: bytes}, and nothing is bounded.
A file that shrank is read on from its new size. Files are reached through pyarrow's file systems (local, HDFS, S3)."""

from __future__ import annotations

import datetime as dt
import fnmatch
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "path string, byte_offset long, line string, mtime timestamp"
RANGE_BYTES, BATCH_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20, 1 << 20
#: Tasks that small ranges are dealt into, as long as that makes none of less than BLOCK_BYTES or more than RANGE_BYTES.
TASKS = 256
#: What a micro-batch with `offsets` reads at most, and after how many numbers the table of all files is written anew.
MAX_BYTES, MAX_FILES, TABLE_EVERY = 4 << 30, 10_000, 100


class RangePartition(InputPartition):
    def __init__(self, path: str, start: int, end: int, mtime: float) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.mtime = path, start, end, mtime


class RunPartition(InputPartition):
    """Ranges that one task reads: (first start, end of the last, range_bytes, mtime) of each file; the ranges of a file follow each other."""

    def __init__(self, files: list[tuple[str, int, int, float]], step: int) -> None:
        super().__init__((files, step))
        self.files, self.step = files, step

    def ranges(self) -> Iterator[list[RangePartition]]:
        """The ranges of each file."""
        for path, start, end, mtime in self.files:
            yield [RangePartition(path, at, min(at + self.step, end), mtime) for at in range(start, end, self.step)]


def _runs(files: list[tuple[str, int, int, float]], step: int) -> list[RunPartition]:
    """The ranges of step bytes of files (path, start, end, mtime), in their order, dealt into runs of at least one range."""
    most = min(RANGE_BYTES, max(BLOCK_BYTES, -(-sum(end - start for _, start, end, _ in files) // TASKS)))
    found, held, left = [], [], most
    for path, at, end, mtime in files:
        while at < end:
            to = min(end, at + max(1, left // step) * step)  # cut where a range ends
            held.append((path, at, to, mtime))
            left, at = left - (to - at), to
            if left < min(step, most):
                found.append(RunPartition(held, step))
                held, left = [], most
    return [*found, RunPartition(held, step)] if held else found


class _Files:
    """Listing and reading that both readers share. Options: path, glob (*.jsonl), modified_after (epoch seconds), range_bytes,
    max_line (bytes beyond which a line is skipped; none unless it is given)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.after, self.longest, self.range = float(options.get("modified_after", "0")), int(options.get("max_line", "0")) or None, int(options.get("range_bytes", RANGE_BYTES))

    def files(self) -> list[fs.FileInfo]:
        system, path = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        hidden = lambda p: any(x.startswith(".") for x in p[len(path) :].split("/"))
        return sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob) and not hidden(f.path) and f.mtime.timestamp() >= self.after), key=lambda f: f.path)

    def lines(self, f: pa.NativeFile, part: RangePartition) -> Iterator[tuple[int, str]]:
        """Lines that begin in [start, end), with their offsets; a line over max_line, if that is given, is skipped."""
        f.seek(max(0, part.start - 1))
        stream = _Lines(f, max(0, part.start - 1), self.longest, part.end - part.start)
        if part.start:
            stream.next()  # what ends at or after start - 1 began before it, unless that byte is a line end
        while stream.at < part.end:
            at, line = stream.at, stream.next()
            if line is None:
                break
            if line.strip():
                yield at, line.decode("utf-8", "replace")

    @staticmethod
    def _batch(part: RangePartition, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        stamp = pa.array([int(part.mtime * 1e6)] * n, pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), stamp], ["path", "byte_offset", "line", "mtime"])


class _Lines:
    """Lines of a file from an offset on; what is read beyond one is kept in pieces, so a long line is joined once. It reads a block of about
    `wanted` bytes first, and larger ones while lines go on. Lines are cut out of a block by their place in it; the block itself is not copied."""

    def __init__(self, f, at: int, longest: int | None, wanted: int = BLOCK_BYTES) -> None:
        self.f, self.at, self.longest, self.held, self.place = f, at, longest, b"", 0
        self.block = min(BLOCK_BYTES, wanted + 256)
        self.ended = True  # whether the last line had an end

    def next(self) -> bytes | None:
        """The next line without its end; b"" for one over the limit; None at the end of the file."""
        parts, n = [], 0
        while (end := self.held.find(b"\n", self.place)) < 0:
            n += len(self.held) - self.place
            parts.append(self.held[self.place :])
            if self.longest and n > self.longest:
                parts.clear()
            self.held, self.place = self.f.read(self.block), 0
            self.block = min(BLOCK_BYTES, 2 * self.block)
            if not self.held:
                self.at += n
                self.ended = False
                return None if not n else b"".join(parts)
        n += end - self.place
        parts.append(self.held[self.place : end])
        self.place = end + 1
        self.at += n + 1
        return b"" if self.longest and n > self.longest else b"".join(parts)


class OffsetLinesReader(DataSourceReader, _Files):
    def __init__(self, options: dict[str, str]) -> None:
        _Files.__init__(self, options)
        self.tests: list[Callable[[fs.FileInfo], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on mtime and path choose files; Spark applies all of them again."""
        for f in filters:
            if (test := _file_test(f)) is not None:
                self.tests.append(test)
            yield f

    def partitions(self) -> list[InputPartition]:
        chosen = [f for f in self.files() if all(test(f) for test in self.tests)]
        return _runs([(f.path, 0, f.size, f.mtime.timestamp()) for f in chosen], self.range)

    def read(self, partition: RunPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, RunPartition):
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        for parts in partition.ranges():
            rows, held = [], 0
            with system.open_input_file(parts[0].path) as f:
                for part in parts:
                    for row in self.lines(f, part):
                        rows.append(row)
                        held += len(row[1])
                        if held >= BATCH_BYTES:
                            yield self._batch(part, rows)
                            rows, held = [], 0
            if rows:
                yield self._batch(parts[0], rows)


_COMPARE = {GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v)}


def _file_test(f: Filter) -> Callable[[fs.FileInfo], bool] | None:
    """What a filter says of a file; None if it says nothing of it."""
    compare = _COMPARE.get(type(f))
    if compare is None or getattr(f, "attribute", None) not in (("mtime",), ("path",)):
        return None
    value = getattr(f, "value", None)
    if f.attribute == ("path",):
        return lambda info: compare(info.path, value)
    if not isinstance(value, dt.datetime):
        return None
    stamp = int((value if value.tzinfo else value.astimezone()).timestamp() * 1e6)
    return lambda info: compare(int(info.mtime.timestamp() * 1e6), stamp)  # as the column has it


class OffsetLinesStream(DataSourceStreamReader, _Files):
    def __init__(self, options: dict[str, str]) -> None:
        _Files.__init__(self, options)
        self.most_bytes, self.most_files = int(options.get("max_bytes", MAX_BYTES)), int(options.get("max_files", MAX_FILES))
        self.plans = _Plans(options["offsets"]) if "offsets" in options else None
        self.number, self.at = -1, {}

    def initialOffset(self) -> dict:
        return {"n": -1} if self.plans else {}

    def latestOffset(self) -> dict:
        if not self.plans:
            return {f.path: f.size for f in self.files()}
        if self.number < 0:  # a new start: from what has been planned, whether it has been read or not
            self.number, self.at = self.plans.load()
        found, rows, left = sorted(self.files(), key=lambda f: (f.mtime, f.path)), [], self.most_bytes
        for f in found:
            at = min(self.at.get(f.path, 0), f.size)  # a file that shrank goes on from its new size
            if at < f.size and left > 0 and len(rows) < self.most_files:
                to = min(f.size, at + left)
                rows.append((f.path, at, to, f.mtime.timestamp()))
                left -= to - at
                self.at[f.path] = to
            elif f.path in self.at:
                self.at[f.path] = at
        if rows:
            self.number += 1
            self.plans.write(self.number, rows)
            if self.number % TABLE_EVERY == 0:
                there = {f.path for f in found}
                self.at = {p: n for p, n in self.at.items() if p in there}
                self.plans.write_table(self.number, self.at)
        return {"n": self.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.plans:
            ranges = [r for n in range(start["n"] + 1, end["n"] + 1) for r in self.plans.read(n)]
        else:
            ranges = [(path, min(start.get(path, 0), to), to, 0.0) for path, to in end.items()]
        return [RangePartition(path, x, min(x + self.range, to), stamp) for path, at, to, stamp in ranges for x in range(at, to, self.range)]

    def commit(self, end: dict) -> None:
        if self.plans:
            self.plans.forget(end["n"])

    def read(self, partition: RangePartition) -> Iterator[pa.RecordBatch]:
        """Lines whose end is in [start, end)."""
        if not isinstance(partition, RangePartition):
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        rows, held = [], 0
        with system.open_input_file(partition.path) as f:
            begin = _line_start(f, partition.start)
            f.seek(begin)
            stream = _Lines(f, begin, self.longest)
            while True:
                at, line = stream.at, stream.next()
                if line is None or not partition.start < stream.at <= partition.end or not stream.ended:
                    break
                if line.strip():
                    rows.append((at, line.decode("utf-8", "replace")))
                    held += len(line)
                if held >= BATCH_BYTES:
                    yield self._batch(partition, rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(partition, rows)


def _line_start(f: pa.NativeFile, at: int) -> int:
    """Where the line that holds the byte `at` begins."""
    while at > 0:
        start = max(0, at - (1 << 16))
        f.seek(start)
        found = f.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


class _Plans:
    """What each number of a stream reads, a file each, and tables of how far every file has been read: <number>.plan and <number>.table."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)

    def _numbers(self, kind: str) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(self.path))
        return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(kind) and not f.base_name.startswith("_"))

    def _put(self, name: str, lines: Iterable[list]) -> None:
        with self.fs.open_output_stream(f"{self.path}/_{name}", compression=None) as out:
            for line in lines:
                out.write(json.dumps(line).encode() + b"\n")
        self.fs.move(f"{self.path}/_{name}", f"{self.path}/{name}")

    def _get(self, name: str) -> list[list]:
        with self.fs.open_input_stream(f"{self.path}/{name}", compression=None) as f:
            return [json.loads(line) for line in f.read().splitlines()]

    def write(self, number: int, rows: list[tuple]) -> None:
        self._put(f"{number:012d}.plan", map(list, rows))

    def read(self, number: int) -> list[list]:
        return self._get(f"{number:012d}.plan")

    def write_table(self, number: int, at: dict[str, int]) -> None:
        self._put(f"{number:012d}.table", map(list, at.items()))

    def load(self) -> tuple[int, dict[str, int]]:
        """The last number, and how far every file has been planned by then."""
        tables, plans = self._numbers(".table"), self._numbers(".plan")
        at = dict(self._get(f"{tables[-1]:012d}.table")) if tables else {}
        for n in plans:
            if not tables or n > tables[-1]:
                at |= {path: to for path, _, to, _ in self.read(n)}
        return max([*plans[-1:], *tables[-1:]], default=-1), at

    def forget(self, number: int) -> None:
        """Plans that have been read and that a table covers go, and all tables but the last two."""
        tables = self._numbers(".table")
        for n in self._numbers(".plan") if tables else []:
            if n < min(number, tables[-1] + 1):
                self.fs.delete_file(f"{self.path}/{n:012d}.plan")
        for n in tables[:-2]:
            self.fs.delete_file(f"{self.path}/{n:012d}.table")


class OffsetLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "offset_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return OffsetLinesReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return OffsetLinesStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OffsetLines)




def progress(spark: SparkSession, path: str, offsets: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, consumed, size) of each file that a stream with the option `offsets` tails: how far it has been planned, and how long it is."""
    at = _Plans(offsets).load()[1]
    rows = [(f.path, min(at.get(f.path, 0), f.size), f.size) for f in _Files({"path": path, "glob": glob}).files()]  # a row for each file, as listed
    return spark.createDataFrame(rows, "path string, consumed long, size long")
