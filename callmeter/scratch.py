"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query that has ended go at once; without it they wait for a collection of the driver's heap.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The scratch tables that passing() has seen so far.
_HELD: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own in local mode, where driver and tasks
    share their disk; on a cluster that is an error, as executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="callmeter-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/callmeter/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """The rows written to a scratch table and read again: lineage ends there and outlives executors. spark: the session that reads them, if not that of
    df; a micro-batch's own session plans without adaptive execution, so each exchange of what follows would be spark.sql.shuffle.partitions tasks."""
    spark, path = spark or df.sparkSession, scratch(df.sparkSession, name)
    if not spark.conf.get(CLEANUP, None):
        spark.conf.set(CLEANUP, "true")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    if (held := _HELD.get()) is not None:
        held.append(table)
    return table


def remove(*tables: DataFrame | None) -> None:
    """Deletes scratch tables that nothing reads any more. Other frames, such as those made from such a table, are left alone."""
    for table in tables:
        path = None if table is None else vars(table).get("scratch_path")
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing() -> Iterator[None]:
    """Scratch tables that are written within are removed at its end, but for those that kept() names."""
    outer = _HELD.get()
    within = _HELD.set([])
    try:
        yield
    finally:
        held = _HELD.get()
        _HELD.reset(within)
        stay = [t for t in held if vars(t).pop("scratch_kept", False)]
        if outer is not None:
            outer.extend(stay)
        remove(*(t for t in held if not any(t is x for x in stay)))


def kept(table: DataFrame) -> DataFrame:
    """A scratch table that outlives the passing() around it; one further out removes it."""
    table.scratch_kept = True
    return table
