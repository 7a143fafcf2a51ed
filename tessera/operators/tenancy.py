"""Tenants: their column is part of every key of the operators that use these."""

from __future__ import annotations

from pyspark.sql import DataFrame

TENANT = "org_id"


def keyed(df: DataFrame, *names: str) -> list[str]:
    """The key columns, after the tenant's if the table has one: rows of two tenants never meet by ids they share."""
    return [TENANT, *names] if TENANT in df.columns else [*names]
