"""Literal allowlists kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drop_allowed(findings: DataFrame, allowed: DataFrame, on: str | list[str] = "text") -> DataFrame:
    """Findings whose key is not on the list. An anti join: Spark broadcasts the
    list when its size allows and shuffles both sides otherwise."""
    return findings.join(allowed, on, "left_anti")
