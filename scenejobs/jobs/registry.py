"""Registered queries of the scene operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers a query under a name, with DuckDB SQL for the same rows where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, without negative zero, so that two engines agree."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _load() -> None:
    from scenejobs.jobs import graph_queries, helper_queries, lane_queries, map_queries, raster_queries, track_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
