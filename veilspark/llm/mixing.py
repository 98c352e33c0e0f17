"""Mixing sources to target weights over fixed-length blocks of words.

The words of each source form one stream, documents in a fixed pseudorandom order,
cut into blocks of `block` words. The mix is a row of slots, `shard` slots to an
output shard. Each slot draws its source: with u uniform in [0, 1), the source whose
interval of cumulated weights holds u, so the counts of a shard are multinomial. The
u of all slots are stratified (one in each n-th of [0, 1), dealt out by a pseudorandom
permutation), so that over the whole mix a source's slots differ from its share by one
or two at most. The j-th slot of a source takes the block that the source's
permutation of block numbers gives for j; the next pass uses another permutation. Slots
join blocks by (source, number).

Prefix sums run over hash buckets of a source first and inside a bucket then, so no
source is ever in one task. Permutations are swap-or-not shuffles, computed per row.

Null and empty texts have no words, take part in no block and have taken 0. A null
source is a source of its own, the last in order. Rows equal in doc_id, source and text
are numbered, so that each has its own place in the stream; in the mix, the columns
beside these are those of one of them. An empty table gives an empty result. Columns
beside doc_id, text and source are ignored or pass through, whatever their names. No document is
taken more than twice, as targets stop at twice a source's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import WORD, renamed, restored, stored

BLOCK, SHARD, BUCKETS = 128, 1024, 1024
WEIGHTS = (3, 1, 2)
#: Rounds of the swap-or-not shuffle; each adds one hash per row.
ROUNDS = 24


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, by key: each round may swap x with (k - x) mod n, as a hash of the larger says."""

    def swap(v: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, k), n) - v, n)
        return F.when(F.xxhash64(key, k, F.greatest(v, other)) % 2 == 0, v).otherwise(other)

    return F.aggregate(F.array(*[F.lit(i).cast("long") for i in range(ROUNDS)]), x, swap)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. They share percent of the total by weight; a target
    stops at `most` times its source's size and the excess goes to the others by weight, until none is above.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most))
    # by cap per weight: the sources that reach their cap come first; level is what the others get per weight
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * (percent / 100.0)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level)
    free = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    return levelled.withColumn("free", free).select(
        "source", "source_size", "weight", F.least("cap", F.coalesce(F.col("free") * F.col("weight"), F.col("cap"))).alias("target")
    )


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def streamed(rows: DataFrame) -> DataFrame:
    """(key, source, size, begin) of rows with words; begin: the place of the first word in the source's stream."""
    rows = rows.filter("size > 0").withColumn("bucket", F.pmod("key", F.lit(BUCKETS)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket")
    buckets = buckets.select(
        F.col("source").alias("of"), F.col("bucket").alias("in"), (F.sum("n").over(upto) - F.col("n")).alias("before")
    )
    own = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.withColumn("upto", F.sum("size").over(own))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))
    more = [c for c in ("row", "copies") if c in rows.columns]
    return inside.join(buckets, same).select("key", *more, "source", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("begin"))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, row, copies, key) of every row: row is equal for equal rows, of which there are `copies`, key is not."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), row_key().alias("row"))
    counted = rows.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("copies"))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.withColumn("key", F.when(F.col("copy") == 0, F.col("row")).otherwise(F.xxhash64("row", "copy"))).drop("copy")


def uniform(seed: int, stratum: Column) -> Column:
    """A number in [0, 1) for each stratum."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("u"), stratum), F.lit(1 << 30)) / float(1 << 30)


def draws(goals: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """The mix: (shard, slot, source, pass, number), one row per slot; number is the block's in its source.

    goals: (source, source_size, target), one row per source. A source's share of the slots is its target over the
    mean size of its blocks, as its last block may be short.
    """
    goals = goals.filter("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    goals = goals.withColumn("share", F.col("target") * F.col("blocks") / F.col("source_size"))
    by_name = F.col("source").asc_nulls_last()
    upto = Window.orderBy(by_name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("share").over(Window.partitionBy())
    goals = goals.withColumn("slots", F.round(total).cast("long"))
    goals = goals.withColumn("to", F.sum("share").over(upto) / total * F.col("slots"))
    goals = goals.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy(by_name)), F.lit(0.0)))
    last = F.lead("to").over(Window.orderBy(by_name)).isNull()
    goals = goals.withColumn("to", F.when(last, F.col("slots").cast("double")).otherwise(F.col("to"))).filter("slots > 0")
    # a source draws the strata in its interval; a stratum on a bound goes to the side of its u
    begin = F.floor("from").cast("long")
    end = F.greatest(begin, F.least(F.floor("to").cast("long"), F.col("slots") - 1))
    part = 20_000
    spans = goals.select(
        "source", "blocks", "slots", "from", "to",
        (begin + F.when(begin + uniform(seed, begin) >= F.col("from"), 0).otherwise(1)).alias("first"),
        end.alias("end"),
        F.explode(F.sequence(begin, end, F.lit(part).cast("long"))).alias("at"),
    )
    # as many partitions as shuffles have: Spark sees few and short rows here and not what they become
    strata = spans.repartition(int(goals.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at", "source").withColumn(
        "stratum", F.explode(F.sequence("at", F.least(F.col("at") + (part - 1), F.col("end"))))
    )
    u = F.col("stratum") + uniform(seed, F.col("stratum"))
    taken = strata.filter((u >= F.col("from")) & (u < F.col("to")))
    numbered = taken.withColumn("j", F.col("stratum") - F.col("first")).withColumn("pass", F.floor(F.col("j") / F.col("blocks")).cast("long"))
    number = permuted(F.pmod("j", F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed), "source", "pass"))
    slot = permuted(F.col("stratum"), F.col("slots"), F.lit(seed).cast("long"))
    # a third pass would take a document more than twice
    return (
        numbered.filter("pass < 2")
        .select("source", "pass", number.alias("number"), slot.alias("slot"))
        .withColumn("shard", F.floor(F.col("slot") / shard).cast("long"))
    )


def pieces(stream: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds number, lo, hi: one row per block that a document reaches, with its words lo .. hi-1 (of the document) in there."""
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)
    cut = stream.withColumn("number", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return cut.withColumn("lo", F.greatest(F.col("number") * block - F.col("begin"), F.lit(0))).withColumn(
        "hi", F.least((F.col("number") + 1) * block - F.col("begin"), F.col("size"))
    )


def plan_mix(docs: DataFrame, weights=WEIGHTS, percent: int = 150, block: int = BLOCK, shard: int = SHARD, seed: int = 0):
    """The numbered rows, goals per source, and the taken pieces: key, row, copies, size, lo, hi, number, and the slot's shard, slot and pass."""
    rows = stored(numbered_rows(docs), "mix-sizes")
    goals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent), "mix-goals")
    cut, drawn = pieces(streamed(rows), block), draws(goals, block, shard, seed)
    # a source's name as a hash keeps null sources joinable
    cut = cut.withColumn("of", F.xxhash64("source"))
    drawn = drawn.withColumn("of", F.xxhash64("source")).withColumnRenamed("source", "drawn_source")
    # neither side is small, whatever Spark's estimate of the exploded slots says
    taken = cut.join(drawn.hint("merge"), ["of", "number"]).filter(F.col("source").eqNullSafe(F.col("drawn_source")))
    return rows, goals, taken.drop("of", "drawn_source")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    rows, goals, taken = plan_mix(docs, **options)
    words = taken.groupBy("key").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    by = goals.select(F.col("source").alias("goal_source"), "source_size", "target")
    return (
        rows.join(words, "key", "left")
        .join(by, F.col("source").eqNullSafe(F.col("goal_source")))
        .select(
            "doc_id",
            "size",
            F.col("source_size").cast("long").alias("source_size"),
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each pass, a document's words that the mix takes, in their order, with the input's columns.

    A document taken whole once gives one row with its whole text; taken twice, two rows. White space behind a word
    stays with it. Rows without words are not taken. n_chars, where there, is that of the new text.
    """
    _, _, taken = plan_mix(docs, **options)
    spans = taken.groupBy("row", "copies", "key", "size", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    given, names = renamed(docs, ("doc_id", "source", "text", "n_chars"))
    given = given.withColumn("row", row_key())
    # rows that are repeated meet the spans of all their copies as one row
    several = spans.filter("copies > 1")
    one = given.join(several.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])
    joined = given.join(spans.filter("copies = 1"), "row").unionByName(one.join(several, "row"))
    words = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])

    def part(span: Column) -> Column:
        return F.array_join(F.slice("words", (span["lo"] + F.col("lead") + 1).cast("int"), (span["hi"] - span["lo"]).cast("int")), "")

    whole = covered == F.col("size")
    # the words are split only where a part is wanted
    joined = joined.withColumn("lead", lead).withColumn("words", F.when(~whole, words))
    cut = F.when(whole, F.col("text")).otherwise(F.array_join(F.transform("spans", part), ""))
    out = joined.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*restored(names))
