"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams of 3 to 5 code points, in lower
case, with white space as one space and a space at either end, hashed to a table of
fixed size. Each feature is scaled by r = log of its smoothed share among toxic texts
over that among the others; logistic regression is fitted on the scaled features, so
a text's score is the logistic function of the sum of r * w over its features.

The classifier is fitted on a bounded sample of labelled rows (`most_toxic`,
`most_other`; the first ones by a hash of doc_id). Each kind weighs as many rows as all
labels have of it, so the scale of the scores is that of the whole labels' mix, whatever
the bounds leave of it. Scoring covers every row and whole
texts. Null and empty texts have no features and get the bias alone. Repeated rows
score alike. A doc_id with two labels counts as toxic if one of them is. Further
columns of the input are not read. With an empty table, or labels of one kind only,
every score is that kind's share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import map_arrow, slices, texts

ORDERS = (3, 4, 5)
BITS = 19
MOST_TOXIC, MOST_OTHER = 2_500, 5_000
#: Characters whose features are computed together when fitting, on the driver.
PART = 250_000
U = np.uint64


def features(some: list[str]) -> list[np.ndarray]:
    """Distinct hashed n-grams of each text."""
    padded = [f" {' '.join(text.lower().split())} " if text and not text.isspace() else "" for text in some]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    buckets = []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        value = value[: max(0, len(points) - n + 1)] * U(0x9E3779B97F4A7C15) + points[n - 1 :] + U(n)
        if n in ORDERS:
            mixed = (value ^ (value >> U(29))) * U(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> U(64 - BITS)).astype(np.int32))
    out, at = [], 0
    seen = np.zeros(1 << BITS, np.int32)
    for text in padded:
        own = [b[at : at + len(text) - n + 1] for n, b in zip(ORDERS, buckets) if len(text) >= n]
        at += len(text)
        if not own:
            out.append(np.zeros(0, np.int32))
            continue
        flat = np.concatenate(own)
        index = np.arange(len(flat), dtype=np.int32)
        seen[flat] = index
        out.append(flat[seen[flat] == index])
    return out


@dataclass(frozen=True)
class Model:
    """Weight of each feature (ratio times fitted weight) and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, some: list[str]) -> np.ndarray:
        margins = np.array([float(self.weights[f].sum(dtype=np.float64)) for f in features(some)]) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(margins, -40, 40)))


def fit_model(some: list[str], toxic: list[bool], least_texts: int = 5, least_ratio: float = 1.0, toxic_weight: float = 4.0, steps: int = 60, rate: float = 0.05, ridge: float = 30.0, stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Naive Bayes ratios and logistic regression on the scaled features (full gradients with adaptive steps).

    stands_for: how many labelled rows a toxic row and another one stand for.
    """
    size, y = 1 << BITS, np.array(toxic, float)
    mass = np.where(y > 0, *stands_for)
    mean = float(np.average(y, weights=mass)) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        share = float(np.clip(mean, 1e-6, 1 - 1e-6))
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    # two passes over the texts, so that only the telling features of all texts are held at once
    in_toxic, in_other = np.ones(size), np.ones(size)
    kinds = iter(y > 0)
    for part in slices(some, most=PART):
        for own in features(part):
            (in_toxic if next(kinds) else in_other)[own] += 1
    ratio = np.log(in_toxic / y.sum()) - np.log(in_other / (1 - y).sum())
    # features of one or two texts say nothing about others
    telling = (in_toxic + in_other - 2 >= least_texts) & (np.abs(ratio) >= least_ratio)
    used = np.flatnonzero(telling)
    rows = [own[telling[own]] for part in slices(some, most=PART) for own in features(part)]
    row = np.repeat(np.arange(len(y)), [len(own) for own in rows])
    local = (np.cumsum(telling) - 1)[np.concatenate(rows)]
    del rows
    scale = ratio[used]
    weight = np.zeros(len(used))
    bias = float(np.log(mean / (1 - mean)))
    mass *= np.where(y > 0, toxic_weight, 1.0) / mass.sum()
    first, second, first_b, second_b = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    for step in range(1, steps + 1):
        margin = np.bincount(row, weights=(weight * scale)[local], minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) * mass
        gradient = np.bincount(local, weights=error[row], minlength=len(used)) * scale + ridge * weight / len(y)
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        first_b, second_b = 0.9 * first_b + 0.1 * error.sum(), 0.99 * second_b + 0.01 * error.sum() ** 2
        step_size = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weight -= step_size * first / (np.sqrt(second) + 1e-8)
        bias -= step_size * first_b / (np.sqrt(second_b) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = weight * scale
    return Model(weights, bias)


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of each labelled id."""
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def sample_labelled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_other: int) -> DataFrame:
    """(text, toxic) of at most so many labelled rows: the first of either kind by a hash of doc_id."""
    marks = marked(labels)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = marks.filter("toxic <> 0").orderBy(*order).limit(most_toxic).union(marks.filter("toxic = 0").orderBy(*order).limit(most_other))
    # at most most_toxic + most_other ids, so the join may broadcast them
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") != 0).alias("toxic"), "doc_id")


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> Model:
    rows = sorted(sample_labelled(docs, labels, most_toxic, most_other).collect(), key=lambda r: (r.doc_id, r.text or ""))
    n = {r.toxic: r["count"] for r in marked(labels).groupBy((F.col("toxic") != 0).alias("toxic")).count().collect()}
    stands_for = tuple(max(1.0, n.get(kind, 0) / max(1, most)) for kind, most in ((True, most_toxic), (False, most_other)))
    return fit_model([r.text or "" for r in rows], [r.toxic for r in rows], stands_for=stands_for)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.concatenate([shared.value.scores(part) for part in slices(texts(batch))])
        predicted = pa.array((scores >= threshold).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), predicted], ["doc_id", "score", "predicted"])

    return map_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind}, score double, predicted int")
