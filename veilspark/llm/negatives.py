"""Hard-negative mining by slot-decomposed selection.

Every anchor has up to `positives` nearest rows of its own label. A negative belongs to
a positive if its score lies between two shares of the positive's score. The positives'
upper limits cut an anchor's scores into disjoint slots: a score's slot is the number of
limits that it does not exceed. Each task keeps the best `negatives` candidates of every
slot; partial lists are merged by slot. As slots descend in score, a positive's answer
is the beginning of its own slot's list followed by those of the lower slots, cut at its
lower limit: the windows overlap, the lists are made once.

Anchors are dealt out to blocks of bounded bytes, built in tasks; each block goes to all
tasks and the table passes by it, twice: for positives and for slots. More anchors mean
more passes, not larger broadcasts. Products are exact: in double precision while no
sum can reach 2**53, else in 64-bit integers.

Rows with a null id, label or vector, or a null or non-finite component take no part;
neither do vectors with a component beyond LARGEST, whose scores might not fit 64 bits.
Only vectors of equal length are compared. A row is named by its id: equal ids with
equal scores count once, and a row is never matched with its own id. Ties go to the
smaller id. Anchors without positives and positives without negatives give no rows.
Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import drop_stored, map_arrow, stored

#: Bytes of a block of anchors' vectors, scores to a tile, and candidates held before lists are cut.
BLOCK_BYTES, TILE, HELD = 16 << 20, 1 << 21, 1 << 18
#: Largest component that takes part.
LARGEST = 1 << 26
LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Rule:
    """Positives to an anchor, negatives to a positive, the window in percent of a positive's score, steps to a unit."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    steps: int = 256


def whole_vectors(rows: DataFrame, rule: Rule) -> DataFrame:
    """(id, label, vec) of the rows that take part; components are floor(steps * x) in whole numbers."""

    def scaled(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        vectors = batch.column("vec")
        keep = np.ones(batch.num_rows, bool)
        at, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
        at, flat = at - at[0], flat[at[0] : at[-1]]
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.floor(flat * rule.steps)
            bad = ~(np.abs(whole) <= LARGEST)
        keep[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = False
        whole = np.where(bad, 0, whole).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(whole))
        made = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), out], ["id", "label", "vec"])
        return made.filter(pa.array(keep))

    given = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull())
    return map_arrow(given.select("id", "label", "vec"), scaled, "id long, label long, vec array<int>")


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors as rows of a matrix), once for each length of vectors."""
    at, flat = batch.column("vec").offsets.to_numpy(), batch.column("vec").values.to_numpy()
    ids, labels, sizes = batch.column("id").to_numpy(), batch.column("label").to_numpy(), np.diff(at)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield ids[own], labels[own], flat[at[own][:, None] + np.arange(size)].reshape(len(own), size)


def anchor_blocks(anchors: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """(part, at, packed): lists of (ids, labels, vectors) of at most `most` bytes of vectors, or one vector."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, labels, vectors in by_length(batch):
                each = 8 * (vectors.shape[1] + 2)
                first = 0
                while first < len(ids):
                    n = max(1, (most - size) // each)
                    if size and size + each > most:
                        yield packed(held)
                        held, size = [], 0
                        continue
                    held.append((ids[first : first + n], labels[first : first + n], vectors[first : first + n]))
                    size += each * len(held[-1][0])
                    first += n
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        joined = []
        for size in sorted({v.shape[1] for _, _, v in held}):
            same = [h for h in held if h[2].shape[1] == size]
            joined.append(tuple(np.concatenate([h[k] for h in same]) for k in range(3)))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(joined)], pa.binary())], ["packed"])

    return anchors.mapInArrow(blocks, "packed binary").select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "packed"
    )


class Best:
    """The best k (score, id) of each of n lists, higher scores first, then smaller ids; equal ones once."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, LEAST)
        self.held, self.size = [], 0

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor[lists]
        if good.any():
            self.held.append((lists[good], scores[good], ids[good]))
            self.size += int(good.sum())
            if self.size > HELD + 2 * self.k * len(self.floor):
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists, scores, ids) that are left, in order."""
        if not self.held:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        lists, scores, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        new = np.ones(len(lists), bool)
        new[1:] = (lists[1:] != lists[:-1]) | (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
        lists, scores, ids = lists[new], scores[new], ids[new]
        begin = np.searchsorted(lists, lists, "left")
        rank = np.arange(len(lists)) - begin
        full = rank == self.k - 1
        self.floor[lists[full]] = scores[full]
        best = rank < self.k
        self.held, self.size = [(lists[best], scores[best], ids[best])], int(best.sum())
        return self.held[0]


@lru_cache(maxsize=1)
def unpacked(packed: bytes) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first anchor, ids, labels, vectors) by length of vectors."""
    out, first = [], 0
    for ids, labels, vectors in pickle.loads(packed):
        out.append((first, ids, labels, vectors))
        first += len(ids)
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products of rows, exact, as 64-bit integers."""
    most = [float(np.abs(side.astype(np.int64)).max(initial=0)) for side in (left, right)]
    if most[0] * most[1] * left.shape[1] < 2.0**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def tiles(groups: list, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors' numbers, ids and labels, rows' ids and labels, scores) of all pairs with vectors of equal length."""
    for ids, labels, vectors in by_length(batch):
        for first, own_ids, own_labels, own in groups:
            if own.shape[1] != vectors.shape[1]:
                continue
            step = max(1, TILE // max(len(ids), 1))
            for a in range(0, len(own), step):
                part = slice(a, a + step)
                numbers = first + np.arange(a, min(a + step, len(own)))
                yield numbers, own_ids[part], own_labels[part], ids, labels, products(own[part], vectors)


def positives_of(rows: DataFrame, shared, rule: Rule) -> DataFrame:
    """(anchor, anchor_id, score, id): partial lists of each anchor's nearest rows of its label, other than itself."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = unpacked(shared.value)
        best = Best(sum(len(g[1]) for g in groups), rule.positives)
        for batch in batches:
            for numbers, own_ids, own_labels, ids, labels, scores in tiles(groups, batch):
                fits = (own_labels[:, None] == labels) & (own_ids[:, None] != ids) & (scores >= best.floor[numbers][:, None])
                a, b = np.nonzero(fits)
                best.add(numbers[a], scores[a, b], ids[b])
        anchor, score, id_ = best.cut()
        named = np.concatenate([g[1] for g in groups])[anchor]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor, named, score, id_)], ["anchor", "anchor_id", "score", "id"])

    return rows.mapInArrow(nearest, "anchor long, anchor_id long, score long, id long")


def slots_of(rows: DataFrame, shared, limits, rule: Rule) -> DataFrame:
    """(anchor, slot, score, id): partial lists of the best rows of other labels in each slot of each anchor.

    limits holds, per anchor, the positives' upper limits (LEAST where there are fewer) and the least lower limit.
    """

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, (upper, least) = unpacked(shared.value), limits.value
        wide, top = upper.shape[1] + 1, upper.max(axis=1)
        best = Best(len(upper) * wide, rule.negatives)
        for batch in batches:
            for numbers, _, own_labels, ids, labels, scores in tiles(groups, batch):
                fits = (own_labels[:, None] != labels) & (scores <= top[numbers][:, None]) & (scores >= least[numbers][:, None])
                a, b = np.nonzero(fits)
                score, anchor = scores[a, b], numbers[a]
                slot = (upper[anchor] >= score[:, None]).sum(axis=1)
                best.add(anchor * wide + slot, score, ids[b])
        lists, score, ids = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (lists // wide, lists % wide, score, ids)], ["anchor", "slot", "score", "id"])

    return rows.mapInArrow(best_of, "anchor long, slot long, score long, id long")


def firsts(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k distinct (score, id) of each key, with their rank; partial lists are cut before they are shuffled on."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def limits_of(found: pa.Table, n: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits of each anchor's positives, and the least of their lower limits (where there are none, beyond all scores)."""
    anchor, score, rank = (found[c].to_numpy() for c in ("anchor", "score", "rank"))
    upper, least = np.full((n, rule.positives), LEAST), np.full(n, np.iinfo(np.int64).max)
    # floor(high * s / 100) and ceil(low * s / 100), without products that overflow
    upper[anchor, rank - 1] = score // 100 * rule.high + score % 100 * rule.high // 100
    np.minimum.at(least, anchor, score // 100 * rule.low - -(score % 100 * rule.low) // 100)
    return upper, least


def mine(rows: DataFrame, anchor: Column, rule: Rule = Rule(), most: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    rows: id, label, vec; anchor: a condition on id that chooses the anchors.
    """
    table = stored(whole_vectors(rows, rule), "whole-vectors")
    anchors = stored(table.filter(anchor).distinct(), "anchors")
    total = anchors.agg(F.sum((F.size("vec") + 2) * F.lit(8).cast("long"))).first()[0] or 0
    blocks = stored(anchor_blocks(anchors.coalesce(max(1, -(-total // most))), most), "anchor-blocks")
    drop_stored(anchors)
    keys = [(r["part"], r["at"]) for r in blocks.select("part", "at").orderBy("part", "at").collect()]
    context, out = rows.sparkSession.sparkContext, None
    for part, at in keys:
        packed = blocks.filter((F.col("part") == part) & (F.col("at") == at)).first()["packed"]
        found = _block(table, packed, context, rule)
        out = found if out is None else out.union(found)
    if out is None:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], kinds)
    drop_stored(blocks)
    return out


def _block(table: DataFrame, packed: bytes, context, rule: Rule) -> DataFrame:
    """The rows of one block of anchors."""
    groups, shared = unpacked(packed), context.broadcast(packed)
    ids = np.concatenate([g[1] for g in groups])
    near = stored(firsts(positives_of(table, shared, rule), ["anchor"], rule.positives), "positives")
    upper, least = limits_of(near.toArrow(), len(ids), rule)
    limits = context.broadcast((upper, least))
    partial = slots_of(table, shared, limits, rule)
    lists = stored(firsts(partial, ["anchor", "slot"], rule.negatives), "slots")
    shared.unpersist()
    limits.unpersist()
    # one list of the slots in their order, best candidates first; a positive's answer begins at its own slot
    ordered = lists.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("lists"))
    hundreds, rest = "(score - pmod(score, 100L)) div 100", "pmod(score, 100L)"
    windows = near.withColumn("upper", F.expr(f"{hundreds} * {rule.high} + {rest} * {rule.high} div 100"))
    windows = windows.withColumn("lower", F.expr(f"{hundreds} * {rule.low} + ({rest} * {rule.low} + 99) div 100"))
    windows = windows.withColumn("own", F.count("*").over(Window.partitionBy("anchor").orderBy(F.desc("upper"))))
    answer = F.slice(F.filter("lists", lambda x: x["slot"] >= F.col("own")), 1, rule.negatives)
    answer = F.filter(answer, lambda x: x["score"] >= F.col("lower"))
    rows = windows.join(ordered, "anchor").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(answer))
    return rows.select(
        "anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("negative_id"), "positive_score",
        F.col("col.score").alias("negative_score"),
    )
