"""Rows of a SQLite table as a read-only source, cut into ranges of rowid; only the asked columns are ever selected, in Arrow batches, and filters on
the table's id narrow the ranges. As a stream, rows are given once they are finished: the offset is {last id, pending: {id: looks at which it was missing}}."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch.
BATCH_ROWS = 10_000
#: Looks at which a pending row may be missing before it is given up.
MISSES = 2


class RowRange(InputPartition):
    def __init__(self, low: int, high: int, without: tuple[int, ...] = (), ids: tuple[int, ...] = ()) -> None:
        super().__init__((low, high))
        self.low, self.high, self.without, self.ids = low, high, without, ids


class _Table:
    """Options: path, table, after (rowids above), rows_per_task, id (the column that is the rowid)."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.path, self.table = schema.fieldNames(), options["path"], options["table"].replace('"', '""')
        self.step, self.id, self.types = int(options.get("rows_per_task", "100000")), options.get("id", "id"), to_arrow_schema(schema)
        self.low, self.high = int(options.get("after", "-1")) + 1, (1 << 63) - 1

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def _ranges(self, low: int, high: int, without: tuple[int, ...] = ()) -> list[InputPartition]:
        con = self._open()
        first, last = con.execute(f'select min(rowid), max(rowid) from "{self.table}" where rowid between ? and ?', (low, high)).fetchone()
        con.close()
        bounds = [(a, min(a + self.step - 1, last)) for a in range(first, last + 1, self.step)] if first is not None else []
        return [RowRange(a, b, tuple(x for x in without if a <= x <= b)) for a, b in bounds]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, RowRange):
            return
        con = self._open()
        names = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        where, values = ("rowid in (select value from json_each(?))", (json.dumps(partition.ids),)) if partition.ids else ("rowid between ? and ? and rowid not in (select value from json_each(?))", (partition.low, partition.high, json.dumps(partition.without)))
        rows = con.execute(f'select {names} from "{self.table}" where {where}{self.only}', values)
        while part := rows.fetchmany(BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), self.types.types, strict=True)], schema=self.types)
        con.close()

    only = ""


class SqliteReader(_Table, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the id narrow the rowids; Spark applies all of them again."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.id,) and getattr(f, "value", None) is not None:
                v = f.value
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, v - isinstance(f, LessThan))
                elif isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, v), min(self.high, v)
                elif isinstance(f, In) and (some := [x for x in v if x is not None]):
                    self.low, self.high = max(self.low, min(some)), min(self.high, max(some))
            yield f

    def partitions(self) -> list[InputPartition]:
        return self._ranges(self.low, self.high)


class SqliteStream(_Table, DataSourceStreamReader):
    """Finished rows of assistants (role and stream as the table has them). What a look finds is kept in the folder `offsets`, so a new start
    goes on from there; pending rows are those in flight at a look."""

    only = " and role = 'assistant' and stream = 0"

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        self.first, self.now = self.low - 1, None
        self.fs, self.folder = fs.FileSystem.from_uri(options["offsets"])

    def initialOffset(self) -> dict:
        return {"last": self.first, "pending": {}}

    def _load(self) -> dict:
        if self.fs.get_file_info(f"{self.folder}/look.json").type == fs.FileType.NotFound:
            return self.initialOffset()
        with self.fs.open_input_stream(f"{self.folder}/look.json") as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        """One look: new rows in flight are pending, pending ones that are finished are not, those missing at MISSES looks in a row are given up."""
        now, con = self.now or self._load(), self._open()
        last = con.execute(f'select max(rowid) from "{self.table}" where rowid > ?', (now["last"],)).fetchone()[0] or now["last"]
        own = lambda where, *v: con.execute(f'select rowid, stream from "{self.table}" where role = \'assistant\' and {where}', v).fetchall()
        flying = {str(i): 0 for i, _ in own("stream <> 0 and rowid > ? and rowid <= ?", now["last"], last)}
        seen = dict(own("rowid in (select value from json_each(?))", json.dumps([int(i) for i in now["pending"]])))
        for i, misses in now["pending"].items():
            if int(i) not in seen and misses + 1 < MISSES:
                flying[i] = misses + 1
            elif seen.get(int(i), 0) != 0:
                flying[i] = 0
        con.close()
        self.now = {"last": last, "pending": flying}
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(f"{self.folder}/_look.json") as out:
            out.write(json.dumps(self.now).encode())
        self.fs.move(f"{self.folder}/_look.json", f"{self.folder}/look.json")
        return self.now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Rows above the last id but those pending at the end, and rows that were pending and are no more."""
        held = [int(i) for i in end["pending"]]
        done = tuple(sorted(int(i) for i in set(start["pending"]) - set(end["pending"])))
        again = [RowRange(0, 0, (), done[i : i + self.step]) for i in range(0, len(done), self.step)]
        return self._ranges(start["last"] + 1, end["last"], tuple(held)) + again


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return "id long, chat_id string, model_name string, role string, created_at string, updated_at string, stream int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SqliteStream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def increment(messages: DataFrame, last_seen: int, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished rows to emit, pending rows of the next look) of a look at messages(id, role, stream, ...).

    Rows above last_seen are new: finished ones are emitted, streaming ones are pending. pending(id, misses) is looked up among all
    rows: finished ones are emitted and no longer pending, missing ones are given up after MISSES looks in a row."""
    own = messages.filter("role = 'assistant'")
    new = own.filter(F.col("id") > last_seen)
    again = own.join(pending.select("id"), "id", "left_semi").filter(F.col("id") <= last_seen)  # calls in flight at once
    finished = new.unionByName(again).filter("stream = 0")
    looked = pending.join(own.select("id", F.lit(True).alias("there")), "id", "left").withColumn("misses", F.when(F.col("there"), 0).otherwise(F.col("misses") + 1)).select("id", "misses")
    open_ = looked.unionByName(new.filter("stream <> 0").select("id", F.lit(0).alias("misses"))).join(finished.select("id"), "id", "left_anti")
    return finished, open_.filter(F.col("misses") < MISSES)
