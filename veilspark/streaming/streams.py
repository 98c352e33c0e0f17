"""Streaming forms: the batch transforms on an unbounded input.

The scan and the log mask keep no state. The roll-ups keep one counter per open
window and key, closed by the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.text import mask_log
from veilspark.plans.audit import RATE_LIMIT, RATE_WINDOW
from veilspark.plans.scan import ScanOptions, scan


def scan_stream(docs: DataFrame, depth: str | Column = "quick", id: str = "doc_id", options: ScanOptions = ScanOptions()) -> DataFrame:
    """Stateless scan of a stream of documents (append mode)."""
    return scan(docs, depth, id=id, options=options)


def mask_log_stream(lines: DataFrame, line: str = "value") -> DataFrame:
    """Mask the line column of a stream of log lines; other columns pass through."""
    return lines.withColumn(line, mask_log(F.col(line)))


def audit_rollup(audit: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", by: tuple[str, ...] = ("event",)) -> DataFrame:
    """Audit rows and findings per time window; rows later than the watermark are dropped."""
    return (
        audit.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n_scans"), F.sum("findings_count").alias("n_findings"))
        .select(F.col("w.start").alias("window_start"), *by, "n_scans", "n_findings")
    )


def rate_alerts(
    requests: DataFrame, key: str = "user_id", ts: str = "ts", window: str = RATE_WINDOW, limit: int = RATE_LIMIT,
    slide: str | None = None, session_gap: str | None = None, lateness: str = "10 minutes",
) -> DataFrame:
    """Keys over the limit in a tumbling, sliding or session window."""
    if session_gap:
        span = F.session_window(ts, session_gap)
    else:
        span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = (
        requests.withWatermark(ts, lateness).groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n_requests"))
    )
    return counted.filter(F.col("n_requests") > limit).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests"
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder.rstrip("/")


def start_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet", **trigger) -> StreamingQuery:
    """Write a stream to files, exactly once; the checkpoint survives lost executors."""
    return (
        stream.writeStream.format(format)
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what its source holds now and read the result back."""
    base = f"{shared_folder(spark)}/veilspark-{uuid.uuid4().hex}"
    query = start_to_table(stream, f"{base}/out", f"{base}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
