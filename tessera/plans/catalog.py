"""Every query of the library by its key, with the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import contents, documents, pages, planning, platform, small, sources, streams, tables

MODULES = (platform, documents, contents, pages, planning, tables, small, sources, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
