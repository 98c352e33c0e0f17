"""Reading tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out evenly over the cores.

    Spark sizes splits so that an input below cores x maxPartitionBytes gets at
    most one split per core, but a row group cannot be split: a table of one row
    group would run as one task. Scans are bound by CPU, so for such an input the
    shuffle pays. A larger input has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Read a file-based table (`parquet`, `orc`, `json`, `csv`, ...)."""
    return spark.read.format(format).options(**options).load(path)


def scan_table(df: DataFrame, id: str = "doc_id", text: str = "text", depth: str | Column | None = None) -> DataFrame:
    """Text requests `(doc_id, text, depth)` out of any table; other columns are
    never read."""
    level = F.lit("quick") if depth is None else (F.col(depth) if isinstance(depth, str) else depth)
    return df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), level.alias("depth"))
