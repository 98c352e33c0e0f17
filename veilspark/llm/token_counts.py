"""Token counts as delta-maintained rollups.

A store is a folder of committed batches. A batch is a set of changes: inserts and
deletes of counts, and revisions from an old to a new count. It is summed to signed
deltas by source, language and tokenizer version, and written under its batch id (any
text but the empty one). Totals are sums of deltas, so the order of batches does not
matter, and a batch is committed once: repeating one that is in the store changes
nothing. Readers see a batch only once its mark is there, which is written last; what a
lost attempt left behind is not counted, and overwritten when the batch comes again. A
store without batches has no rows.

A null source, language or version is a group of its own. Counts that are null are 0.
Each change row counts, repeated ones too. Groups whose documents and tokens are both 0
stay in the totals. Further columns of the changes are ignored; an empty batch is
committed and adds nothing.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch string"


#: The file that makes a batch part of the store, written when all of its own files are there.
MARK = "_committed"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _mark(spark: SparkSession, folder: str):
    return _files(spark, f"{folder}/{MARK}")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by source, lang and tokenizer of changes (op, source, lang, tokenizer, old_tokens, new_tokens).

    op: insert (new_tokens), delete (old_tokens) or revise (both).
    """
    add = F.when(F.col("op").isin("insert", "revise"), F.coalesce("new_tokens", F.lit(0))).otherwise(0)
    take = F.when(F.col("op").isin("delete", "revise"), F.coalesce("old_tokens", F.lit(0))).otherwise(0)
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(add - take).cast("long").alias("tokens"))


def commit(changes: DataFrame, store: str, batch: str) -> bool:
    """Commit a batch; False where the store has it already."""
    if not batch:
        raise ValueError("a batch needs an id")
    spark, folder = changes.sparkSession, f"{store}/{quote(batch, safe='')}"
    mark, files = _mark(spark, folder)
    if files.exists(mark):
        return False
    deltas(changes).withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(folder)
    files.create(mark, False).close()
    return True


def committed(spark: SparkSession, store: str) -> list[str]:
    """The folders of the committed batches, one per batch."""
    where, files = _files(spark, store)
    folders = [str(f.getPath()) for f in files.listStatus(where) if f.isDirectory()] if files.exists(where) else []
    return sorted(f for f in folders if files.exists(_mark(spark, f)[0]))


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """All committed deltas with their batch."""
    folders = committed(spark, store)
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version."""
    return ledger(spark, store).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
