"""Queries that run as streams: micro-batches of the tables through files, each a new start from the checkpoint; their results stand in a store."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import exchange
from ..scratch import scratch, written
from ..sources import collect, lines, sqlite
from ..sources.adapter import usage_events
from ..streaming import alerts, exchanges, shadows
from ..streaming.store import Store
from .collected import CALLS, MESSAGES, captured, messages
from .kept import US
from .registry import query


#: Whether a start ends with a micro-batch without rows, for what the watermark alone brings out.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def in_steps(made: DataFrame, step: str, n: int, start: Callable[[DataFrame], DataStreamWriter], no_data: bool = True) -> None:
    """Writes the rows of each step (0 to n - 1) of made and takes them through the stream, which starts anew each time. no_data: also through a micro-batch
    without rows, where the watermark alone brings something out."""
    spark, folder = made.sparkSession, scratch(made.sparkSession, "stream")
    before = spark.conf.get(NO_DATA)
    try:
        spark.conf.set(NO_DATA, str(no_data).lower())
        _in_steps(made, step, n, start, folder)
    finally:
        spark.conf.set(NO_DATA, before)


def _in_steps(made: DataFrame, step: str, n: int, start: Callable[[DataFrame], DataStreamWriter], folder: str) -> None:
    spark = made.sparkSession
    made = written(made, "steps")
    for i in range(n):
        made.filter(F.col(step) == i).drop(step).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(made.drop(step).schema).parquet(f"{folder}/in")
        start(rows).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured bytes in three micro-batches, cut within messages; the calls of each go into a store as they end."""
    pieces, store = written(captured(spark, sf_dir), "captured"), Store(spark, scratch(spark, "calls"))
    most = pieces.agg(F.max(F.floor(F.col("seq") / 100000)).alias("n")).first().n or 0
    part = F.when(F.col("seq") < 100000 * (most // 3) + 2, 0).when(F.col("seq") < 100000 * (2 * most // 3) + 1, 1).otherwise(2)
    deliver = lambda calls, n: store.upsert("exchange")(collect.as_usage_events(exchange.as_events(calls)), n)
    run = exchanges.assemble(spark, scratch(spark, "open"), deliver)
    in_steps(pieces.withColumn("step", part), "step", 3, lambda rows: exchanges.framed(rows.withWatermark("ts", "1 hour")).writeStream.foreachBatch(run))
    return store.rows().select("dedup_key", "session_id", "input_tokens", "output_tokens", "token_accuracy", "status", "endpoint")


query("exchange_stream", f"with k as ({CALLS}) select 'proxy:' || conn_id || ':' || n as dedup_key, 'ollama-direct' as session_id, input as input_tokens, case when output > 0 then output else approx_output end as output_tokens, case when status = 'failed' then 'unknown' else 'exact' end as token_accuracy, status, path as endpoint from k where output > 0 or approx_output > 0 or input > 0 or status = 'failed'")(_exchanges)

#: Steps by time: each a third of the month, so that what a step explains is there already or comes with it.
STEP = "cast(floor((day(ts) - 1) / 11.0) as int)"


def _shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, store = usage_events(spark, sf_dir, True).filter("provider = 'ollama'"), Store(spark, scratch(spark, "calls"))
    in_steps(x.withColumn("step", F.expr(STEP)), "step", 3, lambda rows: shadows.pairs(rows, "1 hour").writeStream.foreachBatch(shadows.hide(store)), no_data=False)
    store.upsert()(x, 0)
    return store.rows().filter("shadowed").select("dedup_key")


MEET = "abs(p.us - t.us) < 90000000 and abs(p.output_tokens - t.output_tokens) <= 2"
NEAR = "abs(k.us - p.us) < 4000000 and (k.model = p.model or k.model = '')"
query("shadow_stream", f"""with b as (select *, epoch_us(ts) as us, {STEP} as step from x where provider = 'ollama'), t as (select * from b where source = 'transcript' and token_accuracy = 'exact'), p as (select * from b where source = 'proxy'), k as (select * from b where source = 'ollamaDesktop'),
m as (select p.dedup_key, row_number() over (partition by t.dedup_key order by p.ts desc, p.dedup_key desc) as n from p, t where p.step < t.step and {MEET}),
hp as (select dedup_key from p where exists (select 1 from t where t.step <= p.step and {MEET}) union select dedup_key from m where n = 1),
v as (select * from p anti join hp using (dedup_key)), d as (select k.dedup_key, row_number() over (partition by p.dedup_key order by k.ts desc, k.dedup_key desc) as n from k, v p where k.step < p.step and {NEAR})
select dedup_key from hp union select dedup_key from k where exists (select 1 from v p where p.step <= k.step and {NEAR}) union select dedup_key from d where n = 1""", twins=True)(_shadows)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in three steps; a reading far ahead brings out those that wait for the watermark. Alerts go into a table by micro-batch."""
    folder = scratch(spark, "alerts")
    r = usage_events(spark, sf_dir).selectExpr("provider as account", "if(arrival_seq % 2 = 0, 'session', 'weekly') as window", "cast(ts as timestamp) as ts", "arrival_seq", "cast(arrival_seq * 7 % 101 as double) as percent")
    ahead = r.agg(F.max("ts").alias("ts")).selectExpr("'none' as account", "'session' as window", "ts + interval 10 days as ts", "0L as arrival_seq", "0D as percent")
    made = r.withColumn("step", F.expr(STEP)).unionByName(ahead.withColumn("step", F.lit(3)))
    in_steps(made, "step", 4, lambda rows: alerts.threshold_alerts(rows, "1 hour").writeStream.foreachBatch(lambda found, n: found.write.mode("overwrite").parquet(f"{folder}/batch={n}")))
    return spark.read.parquet(folder).select("account", "window", US("ts").alias("ts_us"), "percent", "band", "alert_id")


query("alert_stream", """with r as (select provider as account, case when arrival_seq % 2 = 0 then 'session' else 'weekly' end as "window", ts, arrival_seq, cast(arrival_seq * 7 % 101 as double) as percent from x),
b as (select *, case when percent >= 90 then 90 when percent >= 75 then 75 when percent >= 50 then 50 when percent >= 25 and "window" = 'session' then 25 else 0 end as band from r),
l as (select *, coalesce(lag(band) over (partition by account, "window" order by ts, arrival_seq), 0) as last from b)
select account, "window", epoch_us(ts) as ts_us, percent, cast(band as bigint) as band, account || '-' || "window" || '-' || band as alert_id from l where band > last""")(_alerts)

# Sources that grow ----------------------------------------------------------------------------------------------------------------


def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files that come in two steps, read in micro-batches of a megabyte at most by a stream that starts anew for the second."""
    folder, state = scratch(spark, "logs"), scratch(spark, "tail")
    made = written(usage_events(spark, sf_dir).selectExpr("concat(dedup_key, ' é ', repeat('x', cast(arrival_seq % 50 as int))) as value", "arrival_seq % 3 = 0 as late"), "lines")
    lines.register(spark)
    for late in (False, True):
        made.filter(F.col("late") == late).select("value").write.mode("append").text(folder)
        source = spark.readStream.format("offset_lines").options(path=folder, glob="*.txt", offsets=f"{state}/offsets", max_bytes=str(1 << 20)).load()
        told = source.writeStream.format("parquet").option("path", f"{state}/out").option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime="0 seconds").start()
        told.processAllAvailable()
        told.stop()
    return spark.read.schema("path string, byte_offset long, line string, mtime timestamp").parquet(f"{state}/out").groupBy("line").agg(F.count("*").alias("n"))


query("tail_stream", "select dedup_key || ' é ' || repeat('x', arrival_seq % 50) as line, cast(1 as bigint) as n from x")(_tail)


def _database(rows: DataFrame, path: str) -> None:
    """Writes rows of messages into a new database file, in one task: such a file has one writer."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = sqlite3.connect(path)
        con.execute(f"create table every (id integer primary key, {', '.join(c for c in names if c != 'id')})")
        for batch in batches:
            con.executemany(f"insert into every ({', '.join(names)}) values ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
        con.execute("create table messages as select * from every where 0")
        con.commit()
        con.close()
        yield pa.RecordBatch.from_arrays([pa.array([1])], ["n"])

    rows.coalesce(1).mapInArrow(run, "n long").collect()


def _desktop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database read in three looks: half of the rows; then the other half, with some of the rows in flight finished and some gone; then more finished."""
    folder = scratch(spark, "desktop")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    path = folder.removeprefix("file://") + "/messages.db"  # SQLite needs a folder that is mounted
    _database(messages(spark, sf_dir).withColumn("stream", F.expr("cast(id % 12 = 6 as int)")), path)
    sqlite.register(spark)
    half = "(select max(id) / 2 from every)"
    looks = (f"insert into messages select * from every where id <= {half}",), ("update messages set stream = 0 where id % 36 = 6", "delete from messages where id % 36 = 18", f"insert into messages select * from every where id > {half}"), ("update messages set stream = 0 where id % 72 = 30",)
    for changes in looks:
        con = sqlite3.connect(path)
        for change in changes:
            con.execute(change)
        con.commit()
        con.close()
        source = spark.readStream.format("sqlite_table").options(path=path, table="messages", offsets=f"{folder}/looks").load()
        source.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{folder}/out").select("id", "chat_id", F.coalesce("model_name", F.lit("")).alias("model"))


query("desktop_stream", f"with m as (select {', '.join(MESSAGES)} from x), h as (select max(id) // 2 as half from m) select id, chat_id, coalesce(model_name, '') as model from m, h where role = 'assistant' and (id % 12 <> 6 or id % 72 = 30 or (id % 36 = 6 and id <= half))")(_desktop)
