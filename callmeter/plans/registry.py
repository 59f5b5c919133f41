"""Named queries and, as DuckDB SQL over the same tables, what they must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import oracle_cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, twins: bool = False):
    """Registers a program (spark, sf_dir) -> DataFrame under a name; oracle: SQL over x, the usage events."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = f"with {oracle_cte(twins)} {oracle}" if not oracle.lstrip().startswith("with") else f"with {oracle_cte(twins)}, {oracle.lstrip()[4:]}"
        return f

    return add
