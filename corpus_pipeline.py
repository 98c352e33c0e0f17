"""A corpus pipeline: five operators over the documents, each stage written as Parquet and read again by the next.

Every stage but the last returns the columns of documents. It works on all rows that
the one before kept, whole texts included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import bpe, language, line_dedup, mixing, ngram_join
from veilspark.llm.shared import WORD, drop_stored, renamed, restored, stored

#: The columns that the stages work on; all others pass through, whatever their names.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: A text in no language (no letters), or with a smaller share of its best language, is rejected.
LEAST_LANGUAGE_SHARE = 0.3
#: Near-duplicates share 80 % of their five-word shingles.
NEAR = ngram_join.Rule(width=5, percent=80)


def with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The documents with a new text; n_chars follows it."""
    out = docs.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with a language; a lang that is null becomes the predicted one.

    The prediction runs beside the row's own columns, so it needs no join.
    """
    given, names = renamed(docs, DOCUMENT)
    marked = language.with_language(given, language.train(docs))
    kept = marked.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*restored(names))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines; a document that has lost all its words goes."""
    given, names = renamed(docs, DOCUMENT)
    out = line_dedup.dedup_lines(given)
    out = out.filter((F.col("n_deleted") == 0) | F.col("text").rlike(WORD))
    return with_text(out, F.col("text"), [inner for inner, _ in names]).select(*restored(names))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that with the smallest doc_id, null last. Rows without words stay.

    Rows are named by what they hold, so ids may repeat or be null; equal rows are copies of one another.
    """
    given, names = renamed(docs, ("text",))
    inner = [c for c, _ in names]
    own = next(c for c, name in names if name == "doc_id")
    keyed = given.withColumn("doc_id", F.xxhash64(*inner))
    groups = ngram_join.jaccard_components(keyed.select("doc_id", "text"), NEAR)
    ids = keyed.select(F.col("doc_id").alias("row"), F.col(own).alias("id")).distinct()
    # one row per different row, with the number of its copies
    rows = groups.filter("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(ids, F.col("doc_id") == F.col("row"))
    best = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row", "copies")).alias("best"))
    best = stored(best.select(F.col("best.row").alias("row"), F.col("best.copies").alias("copies")), "pipeline-kept")
    wordless = keyed.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    single = keyed.join(best.filter("copies = 1"), F.col("doc_id") == F.col("row"), "left_semi")
    copied = keyed.join(best.filter("copies > 1"), F.col("doc_id") == F.col("row"), "left_semi").dropDuplicates(["doc_id"])
    return wordless.union(single).union(copied).select(*restored(names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by target weights; a document that is taken twice gives two rows, one that is taken in part that part."""
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the bytes that they decode to, one row per row of the mix."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_near),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_bytes),
]
#: The model of the first stage is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            drop_stored(last)
    return STAGES[-1][1](spark, docs, sf_dir)
