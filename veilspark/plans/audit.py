"""Audit rows, corpus report, retention, rate report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import utf16_units

AUDIT_TEXT = ("ts", "event", "input_length", "findings_count", "depth")
AUDIT_FILE = (
    "ts", "event", "filename", "file_size", "file_type", "extracted", "source_type", "findings_count", "depth",
)

# Lifetimes and limits.
HISTORY_HOURS, HISTORY_LIMIT, AUDIT_HOURS = 24, 50, 48
RATE_LIMIT, RATE_WINDOW = 30, "60 seconds"
PREVIEW = 80


def input_length(text: Column) -> Column:
    return utf16_units(text)


def audit_texts(scanned: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per scanned text, from a scan that kept `input_length`. Never holds
    text. `now` is injected so that a rerun gives the same rows."""
    return scanned.select(
        (F.current_timestamp() if now is None else now).alias("ts"),
        F.lit("scan_text").alias("event"),
        F.col("input_length").cast("bigint").alias("input_length"),
        F.col("n_findings").alias("findings_count"),
        "depth",
    )


def audit_files(scanned: DataFrame, now: Column | None = None) -> DataFrame:
    """One row per scanned file, from its metadata and counts."""
    return scanned.select(
        (F.current_timestamp() if now is None else now).alias("ts"),
        F.lit("scan_file").alias("event"),
        "filename",
        "file_size",
        "file_type",
        "extracted",
        "source_type",
        F.col("n_findings").alias("findings_count"),
        "depth",
    )


def corpus_report(scanned: DataFrame) -> DataFrame:
    """Findings and documents by source x entity, with subtotals per source and a
    total (NULL means all).

    Each document is first reduced to one row per level it contributes to, so the
    count of documents needs no distinct and the shuffle carries partial sums.
    """
    keys = F.transform("findings", lambda f: F.struct(f["source"].alias("source"), f["entity_type"].alias("entity_type")))
    per_source = F.transform("findings", lambda f: F.struct(f["source"].alias("source"), F.lit(None).cast("string").alias("entity_type")))
    total = F.transform(
        "findings", lambda f: F.struct(F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("entity_type"))
    )
    levels = scanned.select(F.concat(keys, per_source, total).alias("k"))
    counted = levels.select(F.explode_outer(_counts("k")).alias("c")).filter(F.col("c").isNotNull())
    return counted.groupBy("c.source", "c.entity_type").agg(
        F.sum("c.n").alias("n_findings"), F.count(F.lit(1)).alias("n_docs")
    )


def _counts(keys: str) -> Column:
    """array<struct<source,entity_type,n>> of the distinct keys of one document."""
    return F.transform(
        F.array_distinct(keys),
        lambda d: F.struct(
            d["source"].alias("source"),
            d["entity_type"].alias("entity_type"),
            F.size(F.filter(keys, lambda k: k["source"].eqNullSafe(d["source"]) & k["entity_type"].eqNullSafe(d["entity_type"]))).cast("bigint").alias("n"),
        ),
    )


def retain(df: DataFrame, now: Column, hours: int = AUDIT_HOURS, ts: str = "ts") -> DataFrame:
    """Rows younger than `hours` at `now`."""
    return df.filter(F.col(ts) > now - F.expr(f"INTERVAL {hours} HOURS"))


def recent_history(
    df: DataFrame, now: Column, user: str = "user_id", ts: str = "ts", tie: str | None = None,
    hours: int = HISTORY_HOURS, limit: int = HISTORY_LIMIT,
) -> DataFrame:
    """Newest first, at most `limit` rows per user, none older than `hours`.

    Spark cuts each user's rows to the limit before the shuffle, so a user with
    very many rows does not end up whole in one task.
    """
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    ranked = retain(df, now, hours, ts).withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def history_entries(scanned: DataFrame) -> DataFrame:
    """History form of scan results. The preview comes from the redacted text, so
    no input is kept."""
    optional = [c for c in ("extracted", "source_type", "filename") if c in scanned.columns]
    return scanned.select(
        "ts",
        F.substring("sanitized", 1, PREVIEW).alias("preview"),
        F.col("n_findings").alias("findings"),
        "depth",
        F.col("sanitized").alias("output"),
        *optional,
    )


def rate_report(
    df: DataFrame, key: str = "user_id", ts: str = "ts", window: str = RATE_WINDOW, limit: int = RATE_LIMIT,
    slide: str | None = None,
) -> DataFrame:
    """Keys with more than `limit` requests in one time window. Counts are partial
    before the shuffle, so a hot key moves one row per task and window."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = df.groupBy(span.alias("w"), key).agg(F.count(F.lit(1)).alias("n_requests"))
    return counted.filter(F.col("n_requests") > limit).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests"
    )


def session_report(df: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = RATE_WINDOW, limit: int = RATE_LIMIT) -> DataFrame:
    """Keys with more than `limit` requests in one session (no pause of `gap`)."""
    counted = df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_requests"))
    return counted.filter(F.col("n_requests") > limit).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_requests"
    )
