"""Queries of sources, sinks and admission."""

from __future__ import annotations

import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.catalog.base import documents, q, query, spans_sql, table
from veilspark.catalog.detection import DOCS, EMAIL_RE2
from veilspark.functions.text import decode_text, utf16_units
from veilspark.operators import admit
from veilspark.operators.rules import detect
from veilspark.operators.structured import EMAIL, IPV4, PHONE
from veilspark.plans.audit import audit_texts
from veilspark.plans.files import scan_files
from veilspark.plans.scan import ScanOptions, scan
from veilspark.schema import PATTERN
from veilspark.sources.files import SOURCE_TYPES, extract_files, list_files, small_parts
from veilspark.sources.sinks import findings_table, write_audit, write_findings, write_results
from veilspark.sources.tables import scan_table
from veilspark.streaming.streams import shared_folder


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/veilspark-{uuid.uuid4().hex}/{name}"


DEPTH = "CASE doc_id % 4 WHEN 0 THEN 'quick' WHEN 1 THEN 'standard' WHEN 2 THEN 'deep' ELSE 'DEEP' END"

query("a1_scan_table", f"SELECT doc_id, {DEPTH} AS depth, md5(text) AS text_md5 FROM documents")(
    lambda spark, sf_dir: scan_table(table(spark, sf_dir, "documents"), depth=F.expr(DEPTH)).select(
        "doc_id", "depth", F.md5("text").alias("text_md5")
    )
)


def write_text_files(spark, sf_dir) -> str:
    """The documents as text files of a bounded number of texts each."""
    path = scratch(spark, "files")
    documents(spark, sf_dir).select("text").write.option("maxRecordsPerFile", 200).text(path)
    return path


EMAIL_ONLY = ScanOptions(entities=("EMAIL_ADDRESS",), secret_rules=())
query(
    "a2_scan_files",
    f"""SELECT 'EMAIL_ADDRESS' AS rule, CAST(count(*) AS BIGINT) AS n, CAST(sum("end" - start) AS BIGINT) AS n_chars FROM ({spans_sql(DOCS, EMAIL_RE2)})""",
)(
    lambda spark, sf_dir: findings_table(scan_files(spark, write_text_files(spark, sf_dir), "standard", EMAIL_ONLY)[0], "path", offsets=True)
    .groupBy("rule")
    .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))
)

query("a3_decode_text", "SELECT doc_id, md5(text || chr(65533)) AS text_md5, CAST(length(text) + 1 AS BIGINT) AS n_chars FROM documents")(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", decode_text(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).alias("t"))
    .select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))
)

PATH = "concat('/in/batch', doc_id % 10, '.d/doc', doc_id, CASE doc_id % 9 WHEN 0 THEN '.TXT' WHEN 1 THEN '.docx' WHEN 2 THEN '' WHEN 3 THEN '.tar.gz' WHEN 4 THEN '/.env' WHEN 5 THEN '.Json' WHEN 6 THEN '.exe' WHEN 7 THEN '.pdf' ELSE '.' END)"
EXT_SQL = f"""SELECT doc_id, lower(CASE WHEN strpos(n, '.') = 0 OR (strpos(n, '.') = 1 AND strpos(substr(n, 2), '.') = 0) THEN '' ELSE '.' || list_last(string_split(n, '.')) END) AS ext
    FROM (SELECT doc_id, list_last(string_split({PATH}, '/')) AS n FROM documents)"""
ALLOWED = ", ".join(q(e) for e in ("", *admit.TEXT_EXTENSIONS, *admit.BINARY_EXTENSIONS))
query(
    "a4_route_by_type",
    f"SELECT doc_id, ext, CASE ext WHEN '.docx' THEN 'Word' WHEN '.pdf' THEN 'PDF' ELSE 'text' END AS source_type, ext IN ('.docx', '.pdf') AS extracted FROM ({EXT_SQL})",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", admit.extension(F.expr(PATH)).alias("ext"))
    .select("doc_id", "ext", source_type(F.col("ext")).alias("source_type"), F.col("ext").isin(*admit.BINARY_EXTENSIONS).alias("extracted"))
)
query("b2_extension_gate", f"SELECT doc_id, ext IN ({ALLOWED}) AS admitted FROM ({EXT_SQL})")(
    lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", admit.admit_ext(F.expr(PATH)).alias("admitted"))
)


def source_type(ext):
    out = F.lit("text")
    for name, label in SOURCE_TYPES.items():
        out = F.when(ext == name, F.lit(label)).otherwise(out)
    return out


def as_docx(batches):
    """Word documents with one paragraph per line of the text."""
    for batch in batches:
        for part in small_parts(batch, "text"):
            contents = []
            for text in part.column("text").to_pylist():
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
                xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("word/document.xml", xml)
                contents.append(out.getvalue())
            n = len(contents)
            columns = [part.column("doc_id"), pa.array([".docx"] * n), pa.array(contents, pa.binary()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file_type", "content", "reject_reason"])


query(
    "a5_extract_docx",
    "SELECT doc_id, md5(replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10)) AS text_md5 FROM documents",
)(
    lambda spark, sf_dir: extract_files(
        documents(spark, sf_dir).mapInArrow(as_docx, "doc_id bigint, file_type string, content binary, reject_reason string")
    ).select("doc_id", F.md5("text").alias("text_md5"))
)


def stored_results(spark, sf_dir):
    path = scratch(spark, "results")
    write_results(scan(scan_table(table(spark, sf_dir, "documents"), depth=F.expr(DEPTH)), F.col("depth"), options=ScanOptions(entities=("EMAIL_ADDRESS",))), path)
    return spark.read.parquet(path)


query(
    "a6_write_results",
    f"SELECT CASE WHEN d IN ('quick', 'standard', 'deep') THEN d ELSE 'quick' END AS depth, CAST(count(*) AS BIGINT) AS n_docs FROM (SELECT {DEPTH} AS d FROM documents) GROUP BY 1",
)(lambda spark, sf_dir: stored_results(spark, sf_dir).groupBy("depth").agg(F.count(F.lit(1)).alias("n_docs")))


def stored_findings(spark, sf_dir):
    path = scratch(spark, "findings")
    write_findings(scan(documents(spark, sf_dir), "standard", options=EMAIL_ONLY), path)
    return spark.read.parquet(path)


query(
    "a7_write_findings",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS BIGINT) AS ord, 'pattern' AS source, 'EMAIL_ADDRESS' AS rule,
        CAST(1.0 AS DOUBLE) AS score, 'EMAIL_ADDRESS' AS description, CAST(NULL AS VARCHAR) AS reason FROM ({spans_sql(DOCS, EMAIL_RE2)})""",
)(stored_findings)

NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def audited(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("input_length", utf16_units(F.col("text")))
    return audit_texts(scan(docs, "standard", options=EMAIL_ONLY, keep=("input_length",)), F.expr(NOW))


def stored_audit(spark, sf_dir):
    path = scratch(spark, "audit")
    write_audit(audited(spark, sf_dir), path)
    return spark.read.parquet(path)


UTF16_SQL = r"length(text) + length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g'))"
AUDIT_SQL = f"""SELECT 'scan_text' AS event, CAST({UTF16_SQL} AS BIGINT) AS input_length,
    CAST(len(regexp_extract_all(text, {q(EMAIL_RE2)})) AS BIGINT) AS findings_count, 'standard' AS depth, {NOW} AS ts FROM documents"""
query("a8_write_audit", AUDIT_SQL)(stored_audit)
query("g2_audit_texts", AUDIT_SQL)(audited)


def file_audit(spark, sf_dir):
    """Files of the given folder itself: metadata only, all of a type that is rejected."""
    files = list_files(spark, sf_dir)
    return files.select("filename", "file_type", "reject_reason", (F.col("file_size") > 0).alias("has_size"))


query(
    "b5_reject_files",
    "SELECT t || '.parquet' AS filename, '.parquet' AS file_type, 'type_not_supported' AS reject_reason, true AS has_size FROM (SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS t)",
)(file_audit)

# -- admission ----------------------------------------------------------------

query(
    "b1_normalise_depth",
    f"SELECT doc_id, CASE WHEN d IN ('quick', 'standard', 'deep') THEN d ELSE 'quick' END AS depth FROM (SELECT doc_id, {DEPTH} AS d FROM documents)",
)(lambda spark, sf_dir: documents(spark, sf_dir).select("doc_id", admit.norm_depth(F.expr(DEPTH)).alias("depth")))

query(
    "b3_size_gate",
    f"SELECT doc_id, CAST({UTF16_SQL} AS BIGINT) AS utf16_units, CAST(strlen(text) AS BIGINT) AS n_bytes, strlen(text) <= 52428800 AS file_admitted FROM documents",
)(
    lambda spark, sf_dir: documents(spark, sf_dir).select(
        "doc_id", utf16_units(F.col("text")).alias("utf16_units"), F.octet_length("text").alias("n_bytes"),
        admit.admit_size(F.octet_length("text")).alias("file_admitted"),
    )
)

HOLED = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE text END"
query("b4_text_gate", f"SELECT doc_id, coalesce(t <> '', false) AS admitted FROM (SELECT doc_id, {HOLED} AS t FROM documents)")(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .withColumn("text", F.expr(HOLED))
    .select("doc_id", admit.admit_text(F.col("text")).alias("admitted"))
)


def split_counts(spark, sf_dir):
    ok, rejected = admit.split_admitted(documents(spark, sf_dir).withColumn("text", F.expr(HOLED)))
    return ok.select("doc_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(rejected.select("doc_id", "reject_reason"))


query("b5_split_admitted", f"SELECT doc_id, CASE WHEN coalesce(t, '') = '' THEN 'no_text' END AS reject_reason FROM (SELECT doc_id, {HOLED} AS t FROM documents)")(split_counts)

ASKED = "CASE doc_id % 4 WHEN 0 THEN 'URL,BSN,NOPE' WHEN 1 THEN 'x,y' WHEN 2 THEN 'PERSON,EMAIL_ADDRESS,PERSON' ELSE '' END"
KNOWN = ", ".join(q(e) for e in admit.ENTITIES)
query(
    "b6_entity_subset",
    f"""SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE [{KNOWN}] END, ',') AS entities
    FROM (SELECT doc_id, list_filter([{KNOWN}], lambda e: list_contains(string_split({ASKED}, ','), e)) AS k FROM documents)""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir).select(
        "doc_id", F.array_join(admit.norm_entities(F.split(F.expr(ASKED), ",")), ",").alias("entities")
    )
)

LIMIT = "CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.6 ELSE NULL END"
query(
    "b7_threshold",
    f"""
    WITH m AS (SELECT doc_id, start, 1.0 AS score FROM ({spans_sql(DOCS, EMAIL_RE2)})
      UNION ALL SELECT doc_id, start, 0.6 FROM ({spans_sql(DOCS, r"(?:[0-9]{1,3}[.]){3}[0-9]{1,3}")})
      UNION ALL SELECT doc_id, start, 0.4 FROM ({spans_sql(DOCS, r"[+]1 [(][0-9]{3}[)] 555-[0-9]{4}")}))
    SELECT doc_id, start, CAST(score AS DOUBLE) AS score FROM m WHERE score >= CASE WHEN coalesce({LIMIT}, 0) = 0 THEN 0.5 ELSE {LIMIT} END""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .withColumn("t", admit.effective_threshold(F.expr(f"CAST({LIMIT} AS double)")))
    .select("doc_id", F.explode_outer(admit.apply_threshold(detect(F.col("text"), [EMAIL, IPV4, PHONE], PATTERN, 0.0), F.col("t"))).alias("f"))
    .filter(F.col("f").isNotNull())
    .select("doc_id", "f.start", "f.score")
)

OUTSIDE = """concat('[{"text": "v', user_id, '", "start": ', event_id, ', "end": ', event_id + 5, ', "score": 0.9}, ',
  CASE event_id % 6 WHEN 0 THEN '{"text": 7, "start": 1, "end": 2}' WHEN 1 THEN '{"text": "a", "start": "1", "end": 2}' WHEN 2 THEN '{"text": "a", "start": 1.5, "end": 2}'
  WHEN 3 THEN '{"text": "ok", "start": 1, "end": 2}' WHEN 4 THEN '"x", null, 5' ELSE '{"start": 1, "end": 2}' END, ']')"""
query(
    "b8_clean_findings",
    """SELECT event_id, 'v' || user_id AS text, CAST(event_id AS BIGINT) AS start, CAST(event_id + 5 AS BIGINT) AS "end" FROM events
    UNION ALL SELECT event_id, 'ok', 1, 2 FROM events WHERE event_id % 6 = 3""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "events")
    .select("event_id", F.explode_outer(admit.clean_findings(F.expr(OUTSIDE))).alias("f"))
    .filter(F.col("f").isNotNull())
    .select("event_id", "f.text", "f.start", "f.end")
)
