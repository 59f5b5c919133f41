"""What stood before a row, as rows stream in: the value of each key's row before, kept over restarts, in order of (ts, arrival_seq).

Rows wait in the key's state until the watermark has passed them, so rows that come late within `late` take their place; later ones are left out. The
state of a key is its last value and the rows that wait."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType


def previous(rows: DataFrame, keys: list[str], value: Column, name: str, late: str = "0 seconds") -> DataFrame:
    """A stream of rows(ts, arrival_seq, ...) with the value (not null) of the row before of the same keys as a string; null for the first."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("_value", value.cast("string"))
    columns = rows.columns

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, None)
        waiting = [pa.ipc.open_stream(held).read_pandas()] if held else []
        waiting += [b for b in batches if len(b)] if not state.hasTimedOut else []
        every = pd.concat(waiting).sort_values(["ts", "arrival_seq"], kind="stable") if waiting else pd.DataFrame(columns=columns)
        passed = (every["ts"].astype("datetime64[us]").astype("int64") // 1000 < state.getCurrentWatermarkMs()).to_numpy() if len(every) else []
        out, rest = (every[passed], every[~passed]) if len(every) else (every, every)
        before = [last, *out["_value"]]
        if len(rest):
            table = pa.Table.from_pandas(rest, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            state.update((before[-1], sink.getvalue().to_pybytes()))
            state.setTimeoutTimestamp(max(int(rest["ts"].iloc[0].timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        else:
            state.update((before[-1], None))
        if len(out):
            yield out.drop(columns="_value").assign(**{name: before[:-1]})

    schema = StructType([f for f in rows.schema if f.name != "_value"] + [StructField(name, StringType())])
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "last string, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
