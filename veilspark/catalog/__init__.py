"""All registered queries."""

from veilspark.catalog import detection, intake, lexical, reports, resolution, scans  # noqa: F401
from veilspark.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
