"""The collectors' observations as one table of usage events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reconcile import reconcile
from ..schema import USAGE_EVENT

#: What a collector that does not tell a column means by it; all others are null.
DEFAULTS = {"input_tokens": 0, "output_tokens": 0, "cache_read": 0, "cache_create": 0, "reasoning": 0, "operation": "unknown", "location": "unknown", "status": "succeeded", "token_accuracy": "unknown", "shadowed": False, "arrival_seq": 0}


def as_usage_events(rows: DataFrame) -> DataFrame:
    """rows with exactly the columns of USAGE_EVENT; other columns go."""
    have = set(rows.columns)
    columns = []
    for f in T.StructType.fromDDL(USAGE_EVENT.replace("\n", " ")):
        value = F.coalesce(F.col(f.name), F.lit(DEFAULTS.get(f.name))) if f.name in have else F.lit(DEFAULTS.get(f.name))
        columns.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*columns)


def union(*collected: DataFrame) -> DataFrame:
    """All observations of all collectors."""
    return reduce(DataFrame.unionByName, [as_usage_events(c) for c in collected])


def silver(*collected: DataFrame) -> DataFrame:
    """The collectors' calls: the strongest observation of each, with those shadowed that another collector saw better."""
    return reconcile(union(*collected))


def replace_models(held: DataFrame, polled: DataFrame, providers: list[str]) -> DataFrame:
    """The snapshot of loaded models in which the polled providers' rows are replaced; a provider polled without models has none."""
    return held.filter(~F.col("provider").isin(*providers)).unionByName(polled.filter(F.col("provider").isin(*providers)))
