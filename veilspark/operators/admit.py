"""Admission: depth, extension, size and text gates; request options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.text import utf16_units
from veilspark.schema import DEPTHS, FINDING, FINDINGS

# File types that are admitted.
TEXT_EXTENSIONS = (
    ".json", ".yaml", ".yml", ".toml", ".env", ".sh", ".bash",
    ".log", ".txt", ".md", ".xml", ".csv", ".ini", ".cfg",
    ".conf", ".properties", ".py", ".js", ".ts", ".html", ".css",
)
BINARY_EXTENSIONS = (".pdf", ".docx")
# Fixed value: largest text or file.
MAX_SIZE = 50 * 1024 * 1024

# Entities of the pattern layer.
ENTITIES = (
    "EMAIL_ADDRESS", "IBAN_CODE", "CREDIT_CARD", "IP_ADDRESS", "URL",
    "PHONE_NUMBER", "PERSON", "LOCATION", "ORGANIZATION",
    "BSN", "KVK_NUMBER", "NL_PHONE_NUMBER",
)

NO_TEXT, TEXT_TOO_LARGE = "no_text", "text_too_large"
BAD_TYPE, FILE_TOO_LARGE, EXTRACT_FAILED = "type_not_supported", "file_too_large", "extraction_failed"


def norm_depth(depth: Column) -> Column:
    """Anything but the three known names means `quick`."""
    return F.when(depth.isin(*DEPTHS), depth).otherwise(F.lit("quick"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none and for dot files such as `.env`."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]*)$", 1))


def admit_ext(path: Column) -> Column:
    return extension(path).isin("", *TEXT_EXTENSIONS, *BINARY_EXTENSIONS)


def admit_size(length: Column) -> Column:
    return length <= F.lit(MAX_SIZE)


def admit_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def text_reject_reason(text: Column) -> Column:
    """NULL for an admitted text. The UTF-16 length is only worked out for a text
    whose byte length leaves the answer open (one unit takes one to three bytes)."""
    return (
        F.when(text.isNull() | (text == ""), F.lit(NO_TEXT))
        .when(F.octet_length(text) <= MAX_SIZE, F.lit(None))
        .when(utf16_units(text) > MAX_SIZE, F.lit(TEXT_TOO_LARGE))
    )


def file_reject_reason(path: Column, length: Column) -> Column:
    """NULL for an admitted file. Uses metadata only, never the content."""
    return F.when(~admit_ext(path), F.lit(BAD_TYPE)).when(~admit_size(length), F.lit(FILE_TOO_LARGE))


def split_admitted(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected); the rejected rows keep everything but the text and
    carry `reject_reason`."""
    marked = df.withColumn("reject_reason", text_reject_reason(F.col(text)))
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()).drop(text),
    )


def norm_entities(requested: Column) -> Column:
    """Known names of the request in the order of the known list; all when none is left."""
    known = F.array(*[F.lit(e) for e in ENTITIES])
    kept = F.array_intersect(known, F.coalesce(requested, F.array().cast("array<string>")))
    return F.when(F.size(kept) > 0, kept).otherwise(known)


def effective_threshold(threshold: Column | float | None, default: float = 0.5) -> Column:
    """A missing or zero threshold means the default."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    return F.when(t.isNull() | (t == 0), F.lit(default)).otherwise(t)


def apply_threshold(findings: Column, threshold: Column) -> Column:
    return F.filter(findings, lambda f: f["score"] >= threshold)


def clean_findings(json: Column) -> Column:
    """Findings from outside, as JSON: an element without a string `text` and
    integer `start` and `end` is dropped, a broken document gives no findings."""

    def kind(element: Column, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(element, f"$.{name}", "variant"))

    elements = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    kept = F.filter(
        elements,
        lambda e: F.coalesce(
            (kind(e, "text") == "STRING") & (kind(e, "start") == "BIGINT") & (kind(e, "end") == "BIGINT"),
            F.lit(False),
        ),
    )
    typed = F.transform(kept, lambda e: F.try_variant_get(e, "$", FINDING))
    return F.coalesce(typed, F.array().cast(FINDINGS))
