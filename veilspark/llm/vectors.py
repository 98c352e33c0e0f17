"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and kept as the signs of its coordinates, with the
inner product of the vector and its code's unit vector as correction factor. From a
code and another vector's rotated coordinates, the inner product of the two vectors is
estimated without bias: inner product of code and vector over the factor. Its error is
bounded, with a confidence set by `deviations`, by how far the factor is from one. A
pair whose upper bound is under the threshold is dropped; all others are computed
exactly, in double precision.

Pairs come from bands of code bits: vectors that agree in all bits of one of the bands
(each from a rotation of its own) meet, within one label. Two vectors at the threshold
miss each other in all bands with a probability under 1e-5, nearer ones far less. Equal
vectors are one vector from the start. In a band's bucket, vectors are held against each
other in pairs of blocks of bounded size; each pair counts in the first band that it
agrees in, so counts of links are summed without a row per pair, and a block gives a
spanning forest of its links only.

A vector that is null, empty, zero or holds a null or a component that is not finite,
or whose label is null, links with nothing. Vectors of different length never link.
Equal vec_ids are told apart; a null vec_id takes part and is never the smallest.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.llm.shared import map_arrow, stored

#: Bands, bits of a band, rotations' seed, vectors to a block.
BANDS, BITS, SEED, BLOCK = 24, 12, 5, 512
#: Width of the confidence bound, in standard deviations of the estimate.
DEVIATIONS = 6.0


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed * 1000 + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(unit: np.ndarray) -> list[np.ndarray]:
    """The vectors under as many rotations as the bands take bits from."""
    dim = unit.shape[1]
    per = max(1, dim // BITS) if dim >= BITS else 1
    return [unit @ rotation(dim, SEED + k).T for k in range(-(-BANDS // per))]


def band_keys(unit: np.ndarray) -> np.ndarray:
    """For each vector, the bits of each band as a number."""
    dim = unit.shape[1]
    bits = min(BITS, dim)
    per = max(1, dim // bits)
    weights = 1 << np.arange(bits)
    turned = rotated(unit)
    return np.stack([(turned[b // per][:, (b % per) * bits : (b % per + 1) * bits] > 0) @ weights for b in range(BANDS)], axis=1)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes' unit vectors, and the correction factors."""
    turned = unit @ rotation(unit.shape[1], SEED).T
    code = np.where(turned > 0, 1.0, -1.0) / np.sqrt(unit.shape[1])
    return turned, code, np.einsum("ij,ij->i", turned, code)


def upper_bounds(left: np.ndarray, right: np.ndarray, deviations: float = DEVIATIONS) -> np.ndarray:
    """Upper confidence bounds of all inner products, from the codes of one side and the rotated vectors of the other."""
    _, code, factor = codes(left)
    turned, _, _ = codes(right)
    estimate = (code @ turned.T) / factor[:, None]
    spread = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / np.sqrt(max(1, left.shape[1] - 1))
    return estimate + deviations * spread[:, None]


def links_of(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of linked vectors: bounds first, then exact inner products of the pairs that are left."""
    possible = upper_bounds(left, right) >= threshold
    if same:
        possible = np.triu(possible | possible.T, 1)
    i, j = np.nonzero(possible)
    keep = []
    for at in range(0, len(i), 200_000):
        a, b = i[at : at + 200_000], j[at : at + 200_000]
        keep.append(np.einsum("ij,ij->i", left[a], right[b]) >= threshold)
    linked = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[linked], j[linked]


def forest(pairs: Iterator[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Pairs that join different trees, so at most size - 1."""
    parent, out = list(range(size)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(row, label, unit, keys) of the vectors that can link; unit: doubles of length one, keys: of the bands."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = {}
        for row, label, vector in zip(*[batch.column(c).to_pylist() for c in ("node", "label", "embedding")]):
            if vector and None not in vector:
                found.setdefault(len(vector), []).append((row, label, vector))
        out = []
        for _, some in sorted(found.items()):
            v = np.array([x[2] for x in some], np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(v).max(axis=1)
            good = np.isfinite(top) & (top > 0)
            v = v[good] / top[good][:, None]
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            keys = band_keys(unit) if len(unit) else []
            out += [(r[0], r[1], u, k) for r, u, k in zip([s for s, g in zip(some, good) if g], unit.tolist(), np.asarray(keys).tolist())]
        if not out:
            return None
        node, label, unit, keys = zip(*out)
        return pa.RecordBatch.from_arrays(
            [pa.array(node, pa.int64()), pa.array(label, pa.string()), pa.array(unit, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))],
            ["node", "label", "unit", "keys"],
        )

    return map_arrow(rows, make, "node long, label string, unit array<double>, keys array<long>")


def block_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(kind, a, b, n) from rows sorted by bucket: kind 0 gives node a n links, kind 1 an edge of the forest."""

    def one(group: dict[str, list]) -> Iterator[tuple[int, int, int, int]]:
        node, weight = np.array(group["node"]), np.array(group["copies"])
        unit, keys = np.array(group["unit"]), np.array(group["keys"])
        own, lo, hi, band = np.array(group["own"]), group["lo"][0], group["hi"][0], group["band"][0]
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(a) or not len(b) or (lo == hi and len(a) < 2):
            return
        i, j = links_of(unit[a], unit[b], threshold, lo == hi)
        i, j = a[i], b[j]
        first = (keys[i] == keys[j]).argmax(axis=1) == band
        i, j = i[first], j[first]
        counts = np.bincount(i, weights=weight[j], minlength=len(node)) + np.bincount(j, weights=weight[i], minlength=len(node))
        for k in np.flatnonzero(counts):
            yield 0, int(node[k]), 0, int(counts[k])
        for x, y in forest(zip(i.tolist(), j.tolist()), len(node)):
            yield 1, int(node[x]), int(node[y]), 0

    names = ("label", "dim", "band", "key", "lo", "hi")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        group: dict[str, list] = {}

        def emit() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "n"])

        for batch in source:
            for row in batch.to_pylist():
                at = tuple(row[c] for c in names)
                if at != held:
                    if group:
                        out.extend(one(group))
                    held, group = at, {c: [] for c in row}
                for c, v in row.items():
                    group[c].append(v)
            if len(out) > 10_000:
                yield emit()
        if group:
            out.extend(one(group))
        if out:
            yield emit()

    # a group is two blocks at most
    return rows.mapInArrow(batches, "kind int, a long, b long, n long")


def near_duplicates(table: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = table.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    # equal vectors of a label are one node, by a hash of both
    rows = rows.withColumn("node", F.xxhash64("label", F.to_json("embedding")))
    distinct = rows.filter("label is not null and embedding is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies")
    )
    units = stored(unit_vectors(distinct.select("node", "label", "embedding")).join(distinct.select("node", "copies"), "node"), "vector-units")
    banded = units.select("node", "label", F.size("unit").alias("dim"), F.posexplode("keys").alias("band", "key"))
    bucket = ["label", "dim", "band", "key"]
    crowded = banded.withColumn("c", F.count("*").over(Window.partitionBy(*bucket))).filter("c > 1")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = crowded.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "blocks", "c")
    full = spread.join(units.select("node", "unit", "keys", "copies"), "node")
    by = [*bucket, "lo", "hi"]
    found = stored(block_links(full.repartition(*by).sortWithinPartitions(*by), threshold), "vector-links")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    labels = stored(components(found.filter("kind = 1").select("a", "b")), "vector-labels")
    valid = units.select("node", F.col("copies").alias("alike"))
    out = rows.select("vec_id", "node").join(valid, "node", "left").join(links, "node", "left").join(labels, "node", "left")
    out = out.withColumn("group", F.when(F.col("alike").isNotNull(), F.coalesce("component", "node")))
    smallest = out.filter("group is not null").groupBy("group").agg(F.min("vec_id").alias("smallest"))
    component = F.coalesce("smallest", "vec_id")
    return out.join(smallest, "group", "left").select(
        "vec_id",
        F.coalesce(F.col("others") + F.col("alike") - 1, F.col("alike") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
