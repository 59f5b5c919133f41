"""Captured exchanges as a stream: connections are framed piece by piece over micro-batches, and calls are told as they end.

What a connection's direction needs to go on (the bytes of the message at hand, its place) is state of that key, so pieces may be cut and dealt into
micro-batches anywhere. Frames of calls that have not ended wait in a table of versions, by a hash of the connection; a micro-batch reads and writes
the buckets of its connections. A call is told once its answer has ended and its request has, or no more requests can come; what was asked
and never answered goes when both directions are closed. A direction without a piece for `idle` seconds of event time is closed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.exchange import FRAMED, STATE, Framer, calls
from ..scratch import written
from ..versions import Versions

BUCKETS, IDLE_SECONDS = 16, 600
NAMES = [part.split(" ")[0] for part in FRAMED.split(", ")]


def framed(exchange: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """FRAMED rows of a stream of exchange(conn_id, seq, direction, bytes, ts, closed) with a watermark on ts, and a row of kind closed where a direction
    ends. Within a micro-batch pieces are taken in order of seq; micro-batches must not overtake each other on a connection."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        request = key[1] == "request"
        *held, k, stamp = state.get if state.exists else (*Framer(request).state(), 0, None)
        framer, out, closed = Framer.resume(request, tuple(held)), [], state.hasTimedOut
        stamp = None if stamp is None else pd.Timestamp(stamp)

        def told(found: Iterator[tuple[int, str, str]]) -> None:
            nonlocal k
            for n, kind, text in found:
                k += 1
                out.append((*key, n, k, kind, text, stamp))

        if not state.hasTimedOut:
            for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
                stamp = row.ts
                told(framer.feed(row.bytes or b""))
                closed = closed or bool(row.closed)
                if row.closed:
                    told(framer.close())
        else:
            told(framer.close())
        if closed:
            told(iter([(framer.n, "closed", "")]))
            if state.exists:
                state.remove()
        else:
            state.update((*framer.state(), k, stamp.to_pydatetime()))
            state.setTimeoutTimestamp(max(int(stamp.timestamp() * 1000) + idle * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=NAMES)

    own = exchange.select("conn_id", "direction", "seq", "bytes", "ts", F.coalesce("closed", F.lit(False)).alias("closed"))
    return own.groupBy("conn_id", "direction").applyInPandasWithState(run, FRAMED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def assemble(spark: SparkSession, folder: str, deliver: Callable[[DataFrame, int], None], stream: str = "exchange") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over framed(): gives the calls that end with a micro-batch to deliver(calls, number), which must take a number
    that comes again as the same (as a store's upsert does)."""
    versions = Versions(spark, folder)

    def run(frames: DataFrame, number: int) -> None:
        state = versions.latest()
        if state["streams"].get(stream, -1) >= number:
            return
        bucket = F.pmod(F.xxhash64("conn_id"), F.lit(BUCKETS)).alias("bucket")
        new = written(frames.select("*", bucket), "new", spark)
        touched = [str(r.bucket) for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        held = versions.read(versions.folders(state, "open", touched), FRAMED).select("*", bucket)
        at_hand = written(held.unionByName(new), "open")
        side = lambda name: F.col("direction") == name
        over = F.col("kind").isin("complete", "cut")
        closed = at_hand.filter("kind = 'closed'").groupBy("conn_id").agg(F.bool_or(side("request")).alias("asked_all"), F.bool_or(side("response")).alias("answered_all"))
        ends = at_hand.groupBy("conn_id", "n").agg(F.bool_or(side("response") & over).alias("answered"), F.bool_or(side("request") & over).alias("asked"))
        done = written(ends.join(closed, "conn_id", "left").filter("answered and (asked or coalesce(asked_all, false))").select("conn_id", "n"), "done")
        frames_of = lambda how: at_hand.filter("kind <> 'closed'").join(done, ["conn_id", "n"], how)
        deliver(calls(frames_of("left_semi").select(*NAMES)), number)
        rest = frames_of("left_anti").unionByName(at_hand.filter("kind = 'closed'")).join(closed.filter("asked_all and answered_all"), "conn_id", "left_anti")
        versions.commit(state, put={"open": dict.fromkeys(touched) | versions.write(state, rest.select(*NAMES, "bucket"), "open", "bucket")}, streams={stream: number})

    return run
