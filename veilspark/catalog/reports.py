"""Queries of logs, audit, retention, rates, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog.base import documents, plain, q, query, spans_sql, table
from veilspark.catalog.detection import DOCS, EMAIL_RE2, IPV4_RE2
from veilspark.catalog.intake import EMAIL_ONLY, write_text_files
from veilspark.functions.text import LOG_MASK, mask_log
from veilspark.plans import audit
from veilspark.plans.files import scan_files
from veilspark.plans.scan import ScanOptions, scan
from veilspark.streaming import streams

LOG_LINE = (
    "concat('user ', c_custkey, ' bsn ', lpad(CAST((c_custkey * 7919 + 100000000) % 1000000000 AS STRING), 9, '0'), ' iban NL91ABNA0', lpad(CAST(c_custkey AS STRING), 9, '0'), "
    "' mob 06-', lpad(CAST((c_custkey * 15485863) % 100000000 AS STRING), 8, '0'), ' int +31 ', lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '0'), ' int +31-6', lpad(CAST((c_custkey * 104729) % 100000000 AS STRING), 8, '0'), ' at ', c_custkey % 9000 + 1000, ' AB end')"
)
MASKED = LOG_LINE
for _p in (r"\b[0-9]{9}\b", r"\bNL\d{2}[A-Z]{4}\d{10}\b", r"\b06[- ]?\d{8}\b", r"\+31[- ]?\d{9}\b", r"\b\d{4}\s?[A-Z]{2}\b"):
    MASKED = f"regexp_replace({MASKED}, {q(_p)}, '{LOG_MASK}', 'g')"

query("g1_mask_log", f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {MASKED} AS line FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", mask_log(F.expr(LOG_LINE)).alias("line"))
)

query(
    "g3_audit_files",
    f"""SELECT 'scan_file' AS event, '.txt' AS file_type, false AS extracted, 'text' AS source_type, 'standard' AS depth,
        CAST(count(*) AS BIGINT) AS findings_count, (SELECT CAST(sum(strlen(text) + 1) AS BIGINT) FROM documents) AS file_size FROM ({spans_sql(DOCS, EMAIL_RE2)})""",
)(
    lambda spark, sf_dir: audit.audit_files(scan_files(spark, write_text_files(spark, sf_dir), "standard", EMAIL_ONLY)[0])
    .groupBy("event", "file_type", "extracted", "source_type", "depth")
    .agg(F.sum("findings_count").alias("findings_count"), F.sum("file_size").alias("file_size"))
)

query(
    "g4_corpus_report",
    f"""
    WITH f AS (SELECT doc_id, 'pattern' AS source, 'EMAIL_ADDRESS' AS entity_type FROM ({spans_sql(DOCS, EMAIL_RE2)})
               UNION ALL SELECT doc_id, 'pattern', 'IP_ADDRESS' FROM ({spans_sql(DOCS, IPV4_RE2)}))
    SELECT source, entity_type, CAST(count(*) AS BIGINT) AS n_findings, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM f GROUP BY ROLLUP (source, entity_type)""",
)(
    lambda spark, sf_dir: audit.corpus_report(
        scan(documents(spark, sf_dir), "standard", options=ScanOptions(entities=("EMAIL_ADDRESS", "IP_ADDRESS"), secret_rules=()))
    )
)

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
query(
    "g5_retention",
    f"SELECT event_id, user_id, ts FROM events WHERE ts > {NOW} - INTERVAL 48 HOURS",
)(lambda spark, sf_dir: audit.retain(plain(spark, sf_dir, "events"), F.expr(NOW)).select("event_id", "user_id", "ts"))
query(
    "g5_recent_history",
    f"""SELECT event_id, user_id, ts, CAST(rank AS BIGINT) AS rank FROM (
      SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events
      WHERE ts > {NOW} - INTERVAL 720 HOURS) WHERE rank <= 50""",
)(
    lambda spark, sf_dir: audit.recent_history(plain(spark, sf_dir, "events"), F.expr(NOW), tie="event_id", hours=720).select(
        "event_id", "user_id", "ts", "rank"
    )
)
RATES = """SELECT user_id, time_bucket(INTERVAL '{w}', ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL '{w}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{w}' AS window_end,
    CAST(count(*) AS BIGINT) AS n_requests FROM events GROUP BY ALL HAVING count(*) > {n}"""
query("g6_rate_report", RATES.format(w="1 hour", n=1))(
    lambda spark, sf_dir: audit.rate_report(plain(spark, sf_dir, "events"), window="1 hour", limit=1)
)
query(
    "g6_rate_report_sliding",
    """SELECT user_id, window_start, window_start + INTERVAL '2 hour' AS window_end, CAST(count(*) AS BIGINT) AS n_requests FROM (
      SELECT user_id, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - to_hours(CAST(k AS BIGINT)) AS window_start FROM events, range(2) r(k)) GROUP BY ALL HAVING count(*) > 2""",
)(lambda spark, sf_dir: audit.rate_report(plain(spark, sf_dir, "events"), window="2 hours", slide="1 hour", limit=2))
SESSIONS = """
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '1 hour' AS window_end, CAST(count(*) AS BIGINT) AS n_requests FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, k HAVING count(*) > 2"""
query("g6_rate_report_sessions", SESSIONS)(lambda spark, sf_dir: audit.session_report(plain(spark, sf_dir, "events"), gap="1 hour", limit=2))

# -- streaming ----------------------------------------------------------------


def stream_of(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def event_stream(spark, sf_dir):
    """Events with `ts` as an instant, which a watermark needs."""
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return stream_of(spark, sf_dir, "events").withColumn("ts", instant)


def wall_clock(df, *names):
    """Instants as UTC wall-clock times, the type of the events table."""
    return df.withColumns({n: F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(n).cast("timestamp_ntz")) for n in names})


query(
    "h1_scan_stream",
    f"""SELECT doc_id, md5(regexp_replace(text, {q(EMAIL_RE2)}, '[EMAIL_ADDRESS]', 'g')) AS sanitized_md5, CAST(len(regexp_extract_all(text, {q(EMAIL_RE2)})) AS BIGINT) AS n_findings FROM documents""",
)(
    lambda spark, sf_dir: streams.drain(
        spark, streams.scan_stream(stream_of(spark, sf_dir, "documents"), "standard", options=EMAIL_ONLY).select("doc_id", F.md5("sanitized").alias("sanitized_md5"), "n_findings")
    )
)
query("h2_mask_log_stream", f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {MASKED} AS value FROM customer")(
    lambda spark, sf_dir: streams.drain(
        spark, streams.mask_log_stream(stream_of(spark, sf_dir, "customer").select("c_custkey", F.expr(LOG_LINE).alias("value")))
    )
)
# windows the final watermark (last event minus the lateness) has closed
CLOSED = "<= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"
query(
    "h3_audit_rollup",
    f"""SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start, event_type AS event, CAST(count(*) AS BIGINT) AS n_scans, CAST(sum(user_id) AS BIGINT) AS n_findings
    FROM events GROUP BY ALL) WHERE window_start + INTERVAL 1 HOUR {CLOSED}""",
)(
    lambda spark, sf_dir: wall_clock(
        streams.drain(
            spark,
            streams.audit_rollup(
                event_stream(spark, sf_dir).select("ts", F.col("event_type").alias("event"), F.col("user_id").alias("findings_count"))
            ),
        ),
        "window_start",
    )
)


def alerts(spark, sf_dir, **options):
    found = streams.drain(spark, streams.rate_alerts(event_stream(spark, sf_dir), **options))
    return wall_clock(found, "window_start", "window_end")


query("h4_rate_alerts", f"SELECT * FROM ({RATES.format(w='1 hour', n=1)}) WHERE window_end {CLOSED}")(
    lambda spark, sf_dir: alerts(spark, sf_dir, window="1 hour", limit=1)
)
query("h4_rate_alerts_sessions", f"SELECT * FROM ({SESSIONS}) WHERE window_end {CLOSED}")(
    lambda spark, sf_dir: alerts(spark, sf_dir, session_gap="1 hour", limit=2)
)
