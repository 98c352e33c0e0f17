"""Line deduplication by winnowing over line hashes.

Lines without a word count for nothing. A gram starts at every line and runs over as
few lines as hold `gram` words; a line's window holds the grams that start within the
next `run - gram` words. The least gram of each window (the leftmost of equals) is a
fingerprint, so two equal runs of lines with `run` words or more always share one,
and no fingerprint stands for fewer than `gram` words.

Fingerprints that stand more than once join positions by content, and each is extended
both ways, a line at a time: a line is deleted if the run from the fingerprint up to it
also stands, with that fingerprint, at an earlier place (in the order of doc_id and line).
Each extension is a key that meets its first place, so a hot fingerprint costs a few rows
per occurrence and never a pair of occurrences, and still every earlier place counts, not
only the first one of the fingerprint. Extensions reach `run` words past the fingerprint and
`run - gram` words before it; a longer run is covered by the fingerprints further on. So
what goes is what comparing each occurrence with all earlier ones would find: each line of
each repeated run of `run` words or more, and of shorter ones that hold a common fingerprint.
The first copy of a run always stays.

Rows with equal doc_id and equal text are one document: both keep the same lines. Null
ids come after all others; null texts stay null, empty texts empty. Further columns
pass through. A document without repeats is unchanged to the byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import WORD, renamed, restored, stored

GRAM, RUN = 25, 50


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, at, line, start, h): lines with words; doc identifies (doc_id, text), at counts lines with words."""
    own = docs.filter("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), "text")
    split = own.select("doc_id", "doc", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    counted = split.withColumn("n", F.regexp_count("content", F.lit(WORD)))
    lines = counted.filter("n > 0").select("doc_id", "doc", "line", "n", F.unhex(F.md5("content")).alias("h"))
    by = Window.partitionBy("doc").orderBy("line")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a repeated row brings each line again, right behind the first
    once = lines.withColumn("last", F.lag("line").over(by)).filter("last is null or last <> line").drop("last")
    return once.withColumn("at", F.row_number().over(by)).withColumn("start", F.sum("n").over(upto) - F.col("n"))


def fingerprints(lines: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """(doc, doc_id, at, g): the chosen grams; g is the hash of the gram's lines."""
    order = Window.partitionBy("doc").orderBy("start")
    total = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("doc"))
    rows = lines.withColumn("total", total).withColumn("parts", F.collect_list("h").over(order.rangeBetween(0, gram - 1)))
    grams = rows.filter(F.col("start") + gram <= F.col("total")).select(
        "doc_id", "doc", "at", "start", "total", F.unhex(F.md5(F.array_join(F.transform("parts", F.hex), ""))).alias("g")
    )
    least = F.min(F.struct("g", "at")).over(order.rangeBetween(0, run - gram))
    windows = grams.withColumn("least", least).filter(F.col("start") + run <= F.col("total"))
    return windows.select("doc_id", "doc", F.col("least.at").alias("at"), F.col("least.g").alias("g")).distinct()


def extensions(lines: DataFrame, marks: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """(key, doc_id, doc, at, gone): for each fingerprint, itself and the runs from it to each line in reach.

    key is the hash of the run's lines; gone are the lines that this run adds to the one that is a line shorter.
    """
    by = Window.partitionBy("doc")
    order = by.orderBy("start")
    near = lines.join(marks.select("doc").distinct(), "doc", "left_semi").join(marks.drop("doc_id"), ["doc", "at"], "left")
    after = F.lead(F.struct("line", "h")).over(by.orderBy("at"))
    placed = near.withColumn("end", F.col("start") + F.col("n")).withColumn("after", after)
    # the lines that begin less than `run` words behind the end of this one
    ahead = F.struct(F.collect_list("after").over(by.orderBy("end").rangeBetween(0, run - 1)).alias("of"))
    placed = placed.withColumn("ahead", ahead).select(
        "doc_id", "doc", "at", "g",
        F.collect_list("line").over(order.rangeBetween(0, gram - 1)).alias("own"),
        F.collect_list(F.struct("line", "h")).over(order.rangeBetween(gram - run, -1)).alias("back"),
        F.last("ahead").over(order.rangeBetween(0, gram - 1))["of"].alias("ahead"),
    )

    def key(sign: str, part):
        return F.unhex(F.md5(F.concat(F.hex("g"), F.lit(sign), F.array_join(F.transform(part, lambda x: F.hex(x["h"])), ""))))

    def option(key, gone):
        return F.struct(key.alias("key"), gone.alias("gone"))

    def upto(name: str):
        return F.when(F.size(name) > 0, F.sequence(F.lit(1), F.size(name))).otherwise(F.array().cast("array<int>"))

    forward = F.transform(upto("ahead"), lambda k: option(key(">", F.slice("ahead", F.lit(1), k)), F.array(F.get("ahead", k - 1)["line"])))
    backward = F.transform(upto("back"), lambda k: option(key("<", F.slice("back", -k, k)), F.array(F.get("back", F.size("back") - k)["line"])))
    own = F.array(option(F.col("g"), F.col("own")))
    rows = placed.filter("g is not null").select("doc_id", "doc", "at", F.explode(F.concat(own, forward, backward)).alias("run"))
    return rows.select("run.key", "doc_id", "doc", "at", "run.gone")


def repeated_lines(docs: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """(doc, line): the lines to delete."""
    lines = stored(line_rows(docs), "line-rows")
    marks = fingerprints(lines, gram, run)
    several = marks.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    marks = stored(marks.join(several, "g", "left_semi"), "line-marks")
    runs = stored(extensions(lines, marks, gram, run), "line-runs")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", "at")
    # the first place of each run: a partial minimum, then one row per run that repeats
    firsts = runs.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = runs.join(firsts, "key").filter((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    return later.select("doc", F.explode("gone").alias("line")).distinct()


def dedup_lines(docs: DataFrame, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """The documents with n_lines (all lines), n_deleted and text without the deleted lines; columns of these names are replaced."""
    runs = repeated_lines(docs, gram, run).withColumn("r", F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line")))
    runs = runs.groupBy("doc", "r").agg(F.min("line").alias("from"), F.max("line").alias("to"))
    gone = runs.groupBy(F.col("doc").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("_gone"))
    given, names = renamed(docs, ("doc_id", "text"))
    joined = given.withColumn("_key", F.xxhash64("doc_id", "text")).join(gone, F.col("_key") == F.col("_doc"), "left")
    lines = F.split("text", "\n", -1)
    # what stays: from behind each run (or the beginning) to the next one (or the end)
    begins = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda run: run["to"] + 1))
    ends = F.concat(F.transform("_gone", lambda run: run["from"]), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(F.col("_lines"), a + 1, b - a)))
    lost = F.aggregate("_gone", F.lit(0), lambda n, run: n + run["to"] - run["from"] + 1)
    return (
        joined.withColumn("_lines", lines)
        .withColumn("n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long"))
        .withColumn("n_deleted", F.coalesce(lost, F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .select(*restored(names, ("n_lines", "n_deleted")), "n_lines", "n_deleted")
    )
