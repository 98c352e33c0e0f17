"""Queries of whole scans and of the model hook."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog.base import documents, luhn_sql, plain, q, query, spans_sql, table
from veilspark.catalog.detection import CARD_RE2, DOCS, EMAIL_RE2, IPV4_RE2, TOKEN_RE2
from veilspark.catalog.intake import DEPTH, write_text_files
from veilspark.operators.allowlist import drop_allowed
from veilspark.operators.lexicon import PERSON_TAG, Lexicon
from veilspark.plans.files import scan_files
from veilspark.plans.scan import ScanOptions, scan
from veilspark.plans.wide import scan_mixed
from veilspark.schema import LEXICON, PATTERN
from veilspark.sources.sinks import findings_table

COUNTS = ("n_findings", "n_secret", "n_pattern", "n_lexicon", "n_xref")

# Documents carry quoted tokens, the only secrets in them.
SECRETS_OF = f"regexp_extract_all(text, {q(TOKEN_RE2)}, 1)"
FIRST_SECRETS = (
    f"list_reduce(list_prepend(text, list_distinct({SECRETS_OF})), "
    "lambda a, s: CASE WHEN strpos(a, s) > 0 THEN substr(a, 1, strpos(a, s) - 1) || '[REDACTED:quoted-secret-assignment]' || substr(a, strpos(a, s) + length(s)) ELSE a END)"
)
N_SECRET = f"CAST(len({SECRETS_OF}) AS BIGINT)"

query(
    "f1_scan_quick",
    f"""SELECT doc_id, 'quick' AS depth, md5({FIRST_SECRETS}) AS sanitized_md5, {N_SECRET} AS n_secret, CAST(len(list_distinct({SECRETS_OF})) AS BIGINT) AS n_findings FROM documents""",
)(
    lambda spark, sf_dir: scan(documents(spark, sf_dir), "quick").select(
        "doc_id", "depth", F.md5("sanitized").alias("sanitized_md5"), "n_secret", "n_findings"
    )
)

SUBSET = ("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD")
CARDS = f"list_filter(regexp_extract_all(text, {q(CARD_RE2)}), lambda c: {luhn_sql('c')})"
STANDARD = (
    f"list_reduce(list_prepend(regexp_replace(regexp_replace({FIRST_SECRETS}, {q(EMAIL_RE2)}, '[EMAIL_ADDRESS]', 'g'), {q(IPV4_RE2)}, '[IP_ADDRESS]', 'g'), "
    f"list_distinct({CARDS})), lambda a, c: replace(a, c, '[CREDIT_CARD]'))"
)
N_PATTERN = f"CAST(len(regexp_extract_all(text, {q(EMAIL_RE2)})) + len(regexp_extract_all(text, {q(IPV4_RE2)})) + len({CARDS}) AS BIGINT)"
query(
    "f2_scan_standard",
    f"SELECT doc_id, md5({STANDARD}) AS sanitized_md5, {N_SECRET} AS n_secret, {N_PATTERN} AS n_pattern FROM documents",
)(
    lambda spark, sf_dir: scan(documents(spark, sf_dir), "standard", options=ScanOptions(entities=SUBSET)).select(
        "doc_id", F.md5("sanitized").alias("sanitized_md5"), "n_secret", "n_pattern"
    )
)

# The lexicon layer of these documents holds only addresses; a claim of the last
# layer is checked by the propagation queries.
DEEP_SQL = f"""SELECT doc_id, {N_SECRET} AS n_secret, {N_PATTERN} AS n_pattern, CAST(len(regexp_extract_all(text, {q(EMAIL_RE2)})) AS BIGINT) AS n_lexicon,
        len({SECRETS_OF}) + len(regexp_extract_all(text, {q(EMAIL_RE2)})) + len(regexp_extract_all(text, {q(IPV4_RE2)})) + len({CARDS}) > 0 AS cross_referenced FROM documents"""


def deep_counts(scanned):
    return scanned.select("doc_id", "n_secret", "n_pattern", "n_lexicon", F.col("n_xref").isNotNull().alias("cross_referenced"))


query("f3_scan_deep", DEEP_SQL)(
    lambda spark, sf_dir: deep_counts(scan(documents(spark, sf_dir), "deep", options=ScanOptions(entities=SUBSET)))
)
# texts of more than 8 kB through the plan for long texts
query("f3_scan_deep_long_texts", DEEP_SQL)(
    lambda spark, sf_dir: deep_counts(scan_mixed(documents(spark, sf_dir), "deep", options=ScanOptions(entities=SUBSET), long_bytes=8000))
)
query("f3_scan_deep_all_entities")(
    lambda spark, sf_dir: scan(documents(spark, sf_dir), "deep", options=ScanOptions(lexicon=Lexicon.of([("Jan", PERSON_TAG)]))).select(
        "doc_id", F.md5("sanitized").alias("sanitized_md5"), *COUNTS
    )
)

query(
    "f4_depth_per_row",
    f"""
    SELECT doc_id, depth, {N_SECRET} AS n_secret, CASE WHEN depth <> 'quick' THEN {N_PATTERN} END AS n_pattern,
      CASE WHEN depth = 'deep' THEN CAST(len(regexp_extract_all(text, {q(EMAIL_RE2)})) AS BIGINT) END AS n_lexicon
    FROM (SELECT doc_id, text, CASE WHEN d IN ('quick', 'standard', 'deep') THEN d ELSE 'quick' END AS depth FROM (SELECT *, {DEPTH} AS d FROM documents))""",
)(
    lambda spark, sf_dir: scan(documents(spark, sf_dir), F.expr(DEPTH), options=ScanOptions(entities=SUBSET)).select(
        "doc_id", "depth", "n_secret", "n_pattern", "n_lexicon"
    )
)


def capital_runs(texts):
    """A stand-in model: two capitalised words are a person; a text with a card-like
    number is more than it can take."""
    import re

    out = []
    for text in texts:
        if re.search(r"\b[0-9]{13,16}\b", text):
            raise ValueError("unsupported")
        out.append([
            {"start": m.start(), "end": m.end(), "entity_type": "PERSON", "score": 0.8}
            for m in re.finditer(r"(?<!\w)[A-Z][a-z]+ [A-Z][a-z]+(?!\w)", text)
        ])
    return out


ASCII_DOCS = "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f]', 'e', 'g') AS text FROM documents"
query(
    "f5_layer_failure",
    f"""
    SELECT doc_id, CASE WHEN regexp_matches(text, '\\b[0-9]{{13,16}}\\b') THEN 'ValueError' END AS lexicon_error,
      CASE WHEN NOT regexp_matches(text, '\\b[0-9]{{13,16}}\\b') THEN CAST(len(regexp_extract_all(text, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b')) AS BIGINT) END AS n_lexicon,
      {N_SECRET} AS n_secret FROM ({ASCII_DOCS})""",
)(
    lambda spark, sf_dir: scan(
        documents(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7f]", "e")),
        "deep",
        options=ScanOptions(entities=SUBSET, lexicon_rules=(), models={LEXICON: capital_runs}),
    ).select("doc_id", F.col("layer_errors")[LEXICON].alias("lexicon_error"), "n_lexicon", "n_secret")
)


def title_model(texts):
    import re

    return [
        [{"start": m.start(), "end": m.end(), "entity_type": "PERSON", "score": 0.8} for m in re.finditer(r"\bNATION_[0-9]+\b", text)]
        for text in texts
    ]


query(
    "i2_model_hook",
    """SELECT CAST(c_custkey AS BIGINT) AS doc_id, concat(c_name, ' from [PERSON].') AS sanitized, CAST(1 AS BIGINT) AS n_pattern FROM customer""",
)(
    lambda spark, sf_dir: scan(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr("concat(c_name, ' from NATION_', c_nationkey, '.')").alias("text")),
        "standard",
        options=ScanOptions(entities=("PERSON",), secret_rules=(), models={PATTERN: title_model}),
    ).select("doc_id", "sanitized", "n_pattern")
)

# An allowlist kept as a table.
query(
    "i3_allowlist_table",
    f"""SELECT doc_id, start, text FROM ({spans_sql(DOCS, IPV4_RE2)}) WHERE CAST(string_split(text, '.')[4] AS BIGINT) NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)""",
)(lambda spark, sf_dir: without_allowed(spark, sf_dir))


def without_allowed(spark, sf_dir):
    """Literal allowlist of any size as an anti join on the matched text."""
    scanned = scan(documents(spark, sf_dir), "standard", options=ScanOptions(entities=("IP_ADDRESS",), secret_rules=()))
    rows = findings_table(scanned, debug=True, offsets=True).withColumn("last", F.expr("try_cast(element_at(split(text, '[.]'), -1) AS bigint)"))
    allowed = plain(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("last"))
    return drop_allowed(rows, allowed, "last").select("doc_id", "start", "text")


query(
    "f6_scan_files_metadata",
    "SELECT '.txt' AS file_type, false AS extracted, 'text' AS source_type, 'quick' AS depth, CAST(sum(strlen(text) + 1) AS BIGINT) AS file_size, CAST(NULL AS BIGINT) AS extracted_length FROM documents",
)(
    lambda spark, sf_dir: scan_files(spark, write_text_files(spark, sf_dir), "quick")[0]
    .groupBy("file_type", "extracted", "source_type", "depth")
    .agg(F.sum("file_size").alias("file_size"), F.sum("extracted_length").alias("extracted_length"))
)
