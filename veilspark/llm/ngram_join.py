"""Jaccard join of documents on word shingles, by prefixes of tokens and of token combinations.

A document's tokens are the hashes of its distinct shingles. Two sets that link differ
by so few tokens that any d + 1 of one hold a token of the other, so each set is indexed
by its first d + 1 tokens in one order of all tokens (its prefix), rare ones first.
Tokens that stand in the prefixes of many sets are frequent. A set with d rare tokens or
fewer has its prefix extended over all its frequent tokens, and these are indexed as
combinations: dealt out by hash to more parts than two linked sets can have
differences, so that one part at least is equal in both. Rare tokens are indexed
alone. Pairs of sets under one index entry are verified exactly.

Exact copies are one set from the start. An entry falls into runs of sizes that no link
spans, and a set alone in its run leaves. Under each entry all sets are first held
against one (that with fewest rare tokens), which then leaves, being done; while the entry holds
several components, this is done again with centers of each entry's own, so that families of alike
texts grow together by as many pairs as they have rows. Only sets that stay in different components after
`STARS` such rounds are held against each other. Entries of more than a few blocks of these are first parted into finer
ones, by what each set differs in from a center: linked sets, not both linked with the center, share one of the
differences, and of any d + 1 differences of one the other has one, d being how far linked sets differ. So a family of
alike texts that do not link gives as many rows as it has differences, not as it has pairs. What remains
meets in blocks of bounded size. Filters on pairs lose
nothing: sizes, and the Hamming distances of parity bitmaps (a second, wider one for
large sets), which are never more than the number of differing tokens. So a group of copies gives about as many pairs as it has
members. The frequent tokens and the sets to look up are handed to tasks as bitmaps of
fixed size; what falsely hits them costs time, not results.

Null and empty texts have no tokens and link with nothing. Texts under the shingle width
have their whole sequence as one token. A null doc_id takes part; component_id is the
smallest id that is not null. Repeated rows are copies. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.llm.shared import drop_stored, map_arrow, slices, stored
from veilspark.llm.wordhash import BatchWords, mix, shingles

U = np.uint64
#: Sets whose prefixes hold a token from which on it is frequent; sets to a block of an entry.
FREQUENT, BLOCK = 48, 256
#: Times that prefixes are counted again without the frequent tokens found so far.
ROUNDS = 1
#: Rounds in which each entry that still holds several components is held against a center of its own.
STARS = 2
#: Blocks that an entry may have before it is parted into finer ones, and rounds in which this is done.
WHOLE, FINER = 2, 2
#: Bits of a bitmap that goes to all tasks (8 MB), of a set's parity bitmap, and of the one that is made for pairs.
BITMAP, PARITY, WIDE = 26, 512, 8192
#: Sets of so many tokens carry a second parity bitmap: unlike sets differ in half of the bits at most, and the difference
#: that a link allows grows with the sets.
LARGE, SECOND = 1500, 2048


@dataclass(frozen=True)
class Rule:
    """Shingle width and least similarity in percent."""

    width: int = 3
    percent: int = 90

    def spare(self, n: int) -> int:
        """Tokens of a set of n that a linked set may lack."""
        return n - -(-self.percent * n // 100)

    def least(self) -> int:
        """Size of the smallest sets that link without being equal."""
        return -(-self.percent // (100 - self.percent))

    def apart(self, n: Column) -> Column:
        """Tokens that stand in one set only, at most, of a set of n and one that it links with."""
        return F.floor((n + F.floor(n * 100 / self.percent)) * (100 - self.percent) / (100 + self.percent))

    def parts(self, n: int) -> list[tuple[int, int]]:
        """(size class, number of parts) under which a set of n tokens is indexed: its own class and the next one.

        Linked sets are in one class or in neighbouring ones; a class has more parts than two linked sets, the larger
        one in it, have differences.
        """
        low, k = self.least(), 0
        while n >= (high := max(low + 1, -(-low * 100 // self.percent))):
            low, k = high, k + 1
        out = []
        for _ in range(2):
            high = max(low + 1, -(-low * 100 // self.percent))
            out.append((k, 2 * (high - 1) * (100 - self.percent) // (100 + self.percent) + 1))
            low, k = high, k + 1
        return out


def token_sets(raw: list[bytes], rule: Rule) -> Iterator[np.ndarray]:
    """Sorted distinct tokens of each text."""
    for part in slices(raw, most=400_000):
        words = BatchWords(part, lower=True)
        every = shingles(words.hashes, rule.width) if len(words.hashes) >= rule.width else None
        bounds = words.bounds.tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < rule.width:
                yield shingles(words.hashes[a:b], rule.width)
                continue
            own = np.sort(every[a : b - rule.width + 1])
            first = np.empty(len(own), bool)
            first[0] = True
            np.not_equal(own[1:], own[:-1], out=first[1:])
            yield own[first]


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = int((tokens * (tokens >> U(7) | U(1))).sum(dtype=np.uint64)) + 0x9E3779B97F4A7C15 * len(tokens)
    total = (total ^ total >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    total ^= total >> 29
    return total - (1 << 64) if total >> 63 else total


def parity(tokens: np.ndarray, bits: int = PARITY) -> np.ndarray:
    odd = np.bincount((tokens >> U(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def hits(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value (unsigned) may be in the set that the bitmap stands for."""
    at = (values & U((1 << BITMAP) - 1)).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & U(1) == 1


def bitmap_of(values: DataFrame, name: str) -> np.ndarray:
    """A bitmap of a column of longs: 2**BITMAP bits, whatever the column holds."""
    at = F.col(name).bitwiseAND(F.lit((1 << BITMAP) - 1))
    word, bit = F.shiftright(at, 6), F.expr(f"shiftleft(1L, cast({name} & 63 as int))")
    rows = values.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def id_names(ids: list[int | None]) -> np.ndarray:
    """A name for each id, under which a bitmap holds it."""
    return mix(np.array([i or 0 for i in ids], np.int64).view(np.uint64))


def ids_bitmap(ids: DataFrame) -> np.ndarray:
    """The bitmap of the names of the ids in column `id`."""

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(id_names(batch.column("id").to_pylist()).view(np.int64))], ["name"])

    return bitmap_of(map_arrow(ids.select("id"), named, "name long"), "name")


@dataclass
class Corpus:
    """The documents to join, with a long `id` (doc_id, or its hash) and text."""

    docs: DataFrame
    rule: Rule
    held: list = field(default_factory=list)

    def share(self, bitmap: np.ndarray | None):
        """Hand a bitmap to all tasks, until release()."""
        self.held.append(self.docs.sparkSession.sparkContext.broadcast(bitmap))
        return self.held[-1]

    def release(self) -> None:
        """Take back what was shared; what was computed with it must be stored by now."""
        while self.held:
            self.held.pop().unpersist()

    def run(self, make: Callable[[np.ndarray], tuple | None], schema: str, chosen: np.ndarray | None = None) -> DataFrame:
        """One pass over the texts: (id, node) and what make(tokens) gives, if not None. chosen: a bitmap of ids to keep to."""
        rule, names = self.rule, [c.split()[0] for c in schema.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
        types = [kinds[c.split()[1]] for c in schema.split(", ")]
        shared = self.share(chosen)

        def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if shared.value is not None:
                batch = batch.filter(pa.array(hits(shared.value, id_names(batch.column("id").to_pylist()))))
            raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.binary())]
            out = []
            for i, tokens in zip(batch.column("id").to_pylist(), token_sets(raw, rule)):
                if (made := make(tokens)) is not None:
                    out.append((i, node_of(tokens), *made))
            if not out:
                return None
            columns = list(zip(*out))
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *types])]
            return pa.RecordBatch.from_arrays(arrays, ["id", "node", *names])

        return map_arrow(self.docs.select("id", "text"), rows, f"id long, node long, {schema}")


def signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def entries(tokens: np.ndarray, frequent: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """Index entries of a set, and how many rare tokens it has."""
    often = hits(frequent, tokens)
    rare, need = tokens[~often], rule.spare(len(tokens)) + 1
    if len(rare) >= need:
        return rare[:need], len(rare)
    common, out = tokens[often], [rare]
    for size_class, parts in rule.parts(len(tokens)):
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, ((common >> U(8)) % U(parts)).astype(np.int64), mix(common))
        out.append(mix(sums + U(size_class) * U(0x9E3779B97F4A7C15) + np.arange(parts, dtype=np.uint64) * U(0xD6E8FEB86659FD93)))
    return np.concatenate(out), len(rare)


def rare_prefix(tokens: np.ndarray, frequent: np.ndarray, rule: Rule) -> np.ndarray:
    """The first tokens that are not known as frequent, as many as a prefix takes."""
    return tokens[~hits(frequent, tokens)][: rule.spare(len(tokens)) + 1]


def linked(pairs: DataFrame, corpus: Corpus, reps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link, by their whole sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = ids_bitmap(reps.join(wanted, "node").select("id"))
    found = corpus.run(lambda tokens: (signed(tokens), parity(tokens, WIDE)), "tokens array<long>, wide array<long>", chosen)
    sets = stored(found, "jaccard-sets")
    corpus.release()
    # the wide bitmaps first, as whole sets of long texts are large to carry along with each pair
    ends = [sets.select(F.col("node").alias(c), F.size("tokens").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab"]
    distance = F.aggregate(F.zip_with("wide_a", "wide_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    percent = corpus.rule.percent
    near = distance * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    pairs = stored(pairs.join(ends[0], "a").join(ends[1], "b").filter(near).select("a", "b"), "jaccard-pairs")
    left, right = [sets.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab"]
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    union = F.size("tokens_a") + F.size("tokens_b") - both
    links = stored(pairs.join(left, "a").join(right, "b").filter(both * 100 >= union * percent).select("a", "b"), "jaccard-links")
    drop_stored(sets)
    drop_stored(pairs)
    return links


def sizes_link(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def may_link(percent: int) -> Column:
    """Filters on pairs with n, m (sizes), p, q (parity bitmaps) and v, w (second ones): false only where the sets cannot link."""
    sizes = sizes_link(F.col("n"), F.col("m"), percent)
    distance = sum((F.bit_count(F.col("p")[k].bitwiseXOR(F.col("q")[k])) for k in range(PARITY // 64)), F.lit(0))
    second = F.aggregate(F.zip_with("v", "w", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)
    near = lambda d: d * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)
    return sizes & near(distance) & F.when((F.size("v") > 0) & (F.size("w") > 0), near(second)).otherwise(True)


def in_runs(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (entry, node, n, ...) under entries of their own for each run of sizes that no link leaves; sets alone in one are gone."""
    by = Window.partitionBy("entry").orderBy("n")
    first = F.coalesce(~sizes_link(F.lag("n").over(by), F.col("n"), percent), F.lit(False))
    rows = rows.withColumn("first", first.cast("int")).withColumn("run", F.sum("first").over(by))
    run = Window.partitionBy("entry", "run")
    rows = rows.withColumn("several", F.min("node").over(run) != F.max("node").over(run)).filter("several")
    return rows.withColumn("entry", F.xxhash64("entry", "run")).drop("first", "run", "several")


def divided(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (entry, node, n) with the component, of entries that hold several components."""
    rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by = Window.partitionBy("entry")
    return rows.withColumn("apart", F.min("component").over(by) != F.max("component").over(by)).filter("apart").drop("apart")


def starred(rows: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a row's node and its center (node, n) that may link."""
    rows = rows.filter((F.col("node") != F.col("center.node")) & sizes_link(F.col("n"), F.col("center.n"), percent))
    pairs = rows.select(F.least("node", "center.node").alias("a"), F.greatest("node", "center.node").alias("b")).distinct()
    pairs = pairs.join(info.select(F.col("node").alias("a"), "n", "p", "v"), "a").join(
        info.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("v").alias("w")), "b"
    )
    return pairs.filter(may_link(percent)).select("a", "b")


def finer(index: DataFrame, labels: DataFrame, corpus: Corpus, reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The index (entry, node, n, hub) with its large entries parted by what their sets differ in from a center, and links (a, b) of
    centers; None without such entries. Entries of one component are gone.

    The center is the hub, or the set under most entries. Its sets' differences are ranked, those that few of them have first;
    the first ones of a set, one more than linked sets differ by, stand for it.
    """
    rule, by = corpus.rule, Window.partitionBy("entry")
    rows = divided(index, labels).withColumn("c", F.count("*").over(by)).withColumn("most", rule.apart(F.max("n").over(by)))
    # a set goes to all blocks, or to its differences: where these are many, some more blocks cost less
    rows = stored(rows.withColumn("large", F.col("c") > BLOCK * F.greatest(F.lit(WHOLE), F.col("most") / 8)), "jaccard-divided")
    rest, large = rows.filter("not large").select("entry", "node", "n", "hub"), rows.filter("large")
    if large.isEmpty():
        return rest, None
    # one center for many entries, so that a set meets few centers
    large = large.withColumn("among", F.count("*").over(Window.partitionBy("node")))
    large = large.withColumn("center", F.coalesce("hub", F.max(F.struct("among", "node")).over(by)["node"]))
    met = stored(large.filter("node <> center").select("node", "center").distinct(), "jaccard-met")
    wanted = met.select("node").union(met.select("center")).distinct()
    chosen = ids_bitmap(reps.join(wanted, "node").select("id"))
    found = corpus.run(lambda tokens: (signed(tokens),), "tokens array<long>", chosen)
    sets = stored(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")
    corpus.release()
    own = sets.select("node", F.col("tokens").alias("own"))
    sides = met.join(own, "node").join(own.toDF("center", "its"), "center")
    delta = F.concat(F.array_except("own", "its"), F.array_except("its", "own"))
    sides = sides.select("center", "node", F.size("own").alias("n"), F.size("its").alias("m"), delta.alias("delta"))
    sides = stored(sides, "jaccard-differences")
    total, x = F.col("n") + F.col("m"), F.size("delta")
    links = sides.filter((total - x) * 100 >= (total + x) * rule.percent)
    links = stored(links.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")), "jaccard-links")
    each = sides.select("center", "node", "n", F.explode("delta").alias("t"))
    counts = each.groupBy("center", "t").agg(F.count("*").alias("c")).filter("c > 1")
    # what one set alone has comes first, but parts nothing
    rank = F.row_number().over(Window.partitionBy("center", "node").orderBy(F.coalesce("c", F.lit(1)), "t"))
    first = each.join(counts, ["center", "t"], "left").withColumn("rank", rank).filter(F.col("rank") <= rule.apart(F.col("n")) + 1)
    parted = first.filter("c > 1").select(F.xxhash64("center", "t").alias("entry"), "node", "n", F.lit(None).cast("long").alias("hub"))
    rest = stored(rest.union(parted), "jaccard-index")
    for done in (rows, met, sets, sides):
        drop_stored(done)
    return rest, links


def candidates(index: DataFrame, info: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes under one entry that may link and are in different components so far."""
    # which entries hold sets of different components is found without the bitmaps, which only their rows carry
    rows = divided(index.select("entry", "node"), labels).withColumn("c", F.count("*").over(Window.partitionBy("entry"))).join(info, "node")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each row goes to the pairs of blocks that hold its own; a bucket of up to BLOCK sets has one
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    left = spread.filter("own = lo").select("entry", "lo", "hi", F.col("node").alias("a"), "n", "p", "v", F.col("component").alias("ca"))
    right = spread.filter("own = hi").select("entry", "lo", "hi", F.col("node").alias("b"), F.col("n").alias("m"), F.col("p").alias("q"), F.col("v").alias("w"), F.col("component").alias("cb"))
    apart = (F.col("ca") != F.col("cb")) & ((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["entry", "lo", "hi"]).filter(apart & may_link(percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    is_long = dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    key = F.col("doc_id").cast("long") if is_long else F.xxhash64("doc_id")
    own = docs.select("doc_id", key.alias("id"), "text")
    corpus = Corpus(own.select("id", "text"), rule)
    least = rule.least()

    # every set's prefix in the order of hashes; its frequent tokens are known after that
    def first_look(tokens: np.ndarray) -> tuple:
        n = len(tokens)
        return n, signed(tokens[: rule.spare(n) + 1]) if n >= least else []

    prefixes = stored(corpus.run(first_look, "n int, prefix array<long>"), "jaccard-sets")
    looked = stored(prefixes.select("id", "node", "n"), "jaccard-sets")
    # one row stands for each distinct set
    reps = stored(looked.filter(F.col("n") >= least).groupBy("node").agg(F.min(F.coalesce("id", F.lit(0))).alias("id")), "jaccard-names")
    all_reps = ids_bitmap(reps)
    frequent = bitmap_of(_frequent(prefixes.select(F.explode("prefix").alias("t"))), "t")
    drop_stored(prefixes)

    # tokens that move up in place of frequent ones are counted in turn
    for _ in range(ROUNDS):
        before = corpus.share(frequent)
        moved = corpus.run(
            lambda tokens: (signed(rare_prefix(tokens, before.value, rule)),) if len(tokens) >= least else None, "tokens array<long>", all_reps
        )
        frequent = frequent | bitmap_of(_frequent(moved.select(F.explode("tokens").alias("t"))), "t")
        corpus.release()

    shared = corpus.share(frequent)

    def indexed(tokens: np.ndarray) -> tuple | None:
        if len(tokens) < least:
            return None
        found, rare = entries(tokens, shared.value, rule)
        return len(tokens), rare, parity(tokens), parity(tokens, SECOND) if len(tokens) >= LARGE else [], signed(found)

    found = stored(corpus.run(indexed, "n int, rare int, p array<long>, v array<long>, entries array<long>", all_reps), "jaccard-info")
    corpus.release()
    info = stored(found.select("node", "n", "p", "v"), "jaccard-info")
    index = in_runs(found.select("node", "n", "rare", F.explode("entries").alias("entry")), rule.percent)
    by = Window.partitionBy("entry")
    index = stored(index.withColumn("center", F.min(F.struct("rare", "node", "n")).over(by)).select("entry", "node", "n", "center", F.col("center.node").alias("hub")), "jaccard-index")
    drop_stored(found)

    # a center is done with its entry
    def held_against_centers(index: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = stored(starred(rows, info, rule.percent), "jaccard-star")
        return linked(pairs, corpus, reps), index.filter(F.col("node") != F.col("center.node")).drop("center", "component")

    links, rest = held_against_centers(index, index)
    labels = stored(components(links), "jaccard-labels")
    for _ in range(STARS):
        before = index
        center = F.min(F.struct(F.xxhash64("entry", "node"), "node", "n", "component")).over(by)
        index = stored(divided(rest, labels).withColumn("center", center), "jaccard-index")
        drop_stored(before)
        more, rest = held_against_centers(index, index.filter(F.col("component") != F.col("center.component")))
        links = links.union(more)
        labels = stored(components(links), "jaccard-labels")
    for _ in range(FINER):
        rest, more = finer(rest, labels, corpus, reps)
        if more is None:
            break
        links = links.union(more)
        labels = stored(components(links), "jaccard-labels")
    rest = stored(candidates(rest, info, labels, rule.percent), "jaccard-rest")
    links = links.union(linked(rest, corpus, reps))
    labels = stored(components(links), "jaccard-labels")

    named = looked.select("id", "node", "n").join(labels, "node", "left")
    named = named.select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("label"))
    if not is_long:
        named = named.join(own.select("doc_id", "id").distinct(), "id", "left")
    else:
        named = named.withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType))
    smallest = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id")
    )


def _frequent(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("t").agg(F.count("*").alias("c")).filter(F.col("c") >= FREQUENT).select("t")
