"""Scan of a directory tree with file metadata on every result row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import utf16_units
from veilspark.plans.scan import ScanOptions, scan
from veilspark.sources.files import read_files


def scan_files(
    spark: SparkSession,
    path: str,
    depth: str = "quick",
    options: ScanOptions = ScanOptions(),
    extractors: dict[str, Callable[[bytes], str]] | None = None,
    **read_options,
) -> tuple[DataFrame, DataFrame]:
    """(results, rejected). An extracted document counts as a plain text file for
    the path allowlist; `extracted_length` is NULL for text files."""
    texts, rejected = read_files(spark, path, extractors, **read_options)
    length = F.when(F.col("extracted"), utf16_units(F.col("text")))
    scanned = scan(
        texts.withColumn("extracted_length", length),
        depth,
        id="path",
        options=options,
        keep=("filename", "file_size", "file_type", "extracted", "source_type", "extracted_length"),
        path=F.when(~F.col("extracted"), F.col("path")),
    )
    return scanned, rejected
