"""Scans that give very long texts a plan of their own.

Inside one row, propagation costs (distinct values x text length), which is small
for ordinary documents but not for, say, a dump of a million addresses in one
file. Such rows go through joins instead, spread over the cluster, with the same
result. The other rows keep the narrow plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.admit import norm_depth
from veilspark.operators.merge import combine, merge_findings_table
from veilspark.operators.redact import layer_count, redact
from veilspark.plans.scan import RESULT, ScanOptions, detect_layers, scan
from veilspark.plans.scoped import propagate_scoped
from veilspark.schema import FINDING_FIELDS, FINDINGS, NO_FINDINGS

LONG_BYTES = 1 << 17


def scan_mixed(
    df: DataFrame,
    depth: str | Column = "quick",
    id: str = "doc_id",
    text: str = "text",
    options: ScanOptions = ScanOptions(),
    keep: Iterable[str] = (),
    long_bytes: int = LONG_BYTES,
    path: Column | None = None,
) -> DataFrame:
    """`scan`, with texts above `long_bytes` taken out to `scan_long`.

    The input is read twice, the second time for the long texts only.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    short = scan(df.filter(size <= long_bytes), depth, id, text, options, keep, path)
    return short.unionByName(scan_long(df.filter(size > long_bytes), depth, id, text, options, keep, path))


def scan_long(
    df: DataFrame,
    depth: str | Column = "quick",
    id: str = "doc_id",
    text: str = "text",
    options: ScanOptions = ScanOptions(),
    keep: Iterable[str] = (),
    path: Column | None = None,
) -> DataFrame:
    """The same result as `scan`, with propagation and merge as joins and windows.

    A result depends on text, depth and path alone, so each distinct triple is scanned
    under the hash of it and its result goes to all its rows. Ids may repeat or be NULL.
    """
    kept = [c for c in dict.fromkeys((id, *keep)) if c not in RESULT]
    level = F.lit(depth) if isinstance(depth, str) else depth
    rows = df.select(
        *kept, F.coalesce(F.col(text), F.lit("")).alias("_body"), norm_depth(level).alias("_level"),
        (F.lit(None).cast("string") if path is None else path.cast("string")).alias("_path"),
    )
    rows = rows.withColumn("_key", F.sha2(F.to_json(F.struct("_body", "_level", "_path")), 256))
    distinct = rows.select("_key", "_body", "_level", "_path").dropDuplicates(["_key"])
    found = _scan_distinct(distinct, depth if isinstance(depth, str) else F.col("_level"), options, None if path is None else F.col("_path"))
    return rows.select(*kept, "_key").join(found, "_key").select(*kept, *RESULT)


def _scan_distinct(df: DataFrame, depth: str | Column, options: ScanOptions, path: Column | None) -> DataFrame:
    """`scan_long` of rows (`_key`, `_body`) with unique keys.

    Detection runs once: its findings, without the text, are checkpointed.
    """
    id, text, kept = "_key", "_body", ["_key"]
    base = df.withColumn("depth", depth) if not isinstance(depth, str) else df
    layers = detect_layers(base, text, depth if isinstance(depth, str) else F.col("depth"), options, path)
    found = layers.select(
        *kept, "depth", "layer_errors",
        combine(F.col("f_secret"), F.col("f_pattern"), F.col("f_lexicon")).alias("raw"),
        *[layer_count(F.col(f"f_{n}")).alias(f"n_{n}") for n in ("secret", "pattern", "lexicon")],
    ).checkpoint()
    texts = df.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    deep = found.filter(F.col("depth") == "deep").select(id, F.col("raw").alias("findings")).join(texts, id)
    extra = propagate_scoped(deep, [id], id, "_text").withColumn("description", F.lit(None).cast("string")).checkpoint()

    rows = found.select(id, F.posexplode("raw").alias("ord", "f")).select(id, "ord", "f.*")
    # claims overlap nothing found, so their order among themselves does not matter
    after = extra.select(id, F.lit(2**31 - 1).alias("ord"), *FINDING_FIELDS)
    merged = merge_findings_table(rows.unionByName(after), id, options.mode)
    packed = merged.groupBy(id).agg(
        F.array_sort(F.collect_list(F.struct(*FINDING_FIELDS))).cast(FINDINGS).alias("findings")
    )
    counts = extra.groupBy(id).agg(F.count(F.lit(1)).cast("int").alias("_claims"))
    joined = found.join(packed, id, "left").join(counts, id, "left").join(texts, id)
    ran = (F.col("depth") == "deep") & (F.size("raw") > 0)
    return joined.withColumn("findings", F.coalesce(F.col("findings"), F.expr(NO_FINDINGS))).select(
        *kept, "depth",
        redact(F.col("_text"), F.col("findings")).alias("sanitized"),
        F.size("findings").alias("n_findings"), "n_secret", "n_pattern", "n_lexicon",
        F.when(ran, F.coalesce(F.col("_claims"), F.lit(0))).alias("n_xref"),
        "layer_errors", "findings",
    )
