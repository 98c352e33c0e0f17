"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters, in lower case) has features: character n-grams with the
word's edges, its first and last letters, and the word itself (lexicon), all hashed
to one table of weights per language. Learned transitions between the languages of
neighbouring words join them; forward-backward gives each word's probabilities, so a
code-switched text is labelled word by word. A text's language is the one with most
letters, counted with these probabilities; its score is that share.

The model is fitted on a bounded sample of rows per language (`most_rows`; the first
ones by a hash of doc_id), whole texts. Their words take the row's language; texts of
different languages follow one another in training sequences, which is where the
transitions come from. Tokens without letters are no words. A text that is null or has
no letter is `und` with score 0. Repeated rows get equal answers. Further columns are
not read. With nothing to learn from, every text is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.shared import map_arrow, renamed, restored, slices, texts

BITS = 18
MOST_ROWS = 150
UNDETERMINED = "und"
#: Characters whose features are computed together (some 100 bytes each), and characters of texts whose chains run together.
TOGETHER, CHAINS = 100_000, 500_000
U = np.uint64


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter, over all planes that hold letters."""
    return np.array([chr(i).isalpha() for i in range(0x33480)])


def scrambled(value: np.ndarray, kind: int) -> np.ndarray:
    value = (value + U(kind)) * U(0x9E3779B97F4A7C15)
    value = (value ^ (value >> U(32))) * U(0xBF58476D1CE4E5B9)
    return (value >> U(64 - BITS)).astype(np.int32)


@dataclass
class Words:
    """The words of some texts: features per letter (two) and per word (three), letters per word, words per text."""

    grams: tuple[np.ndarray, np.ndarray]
    wholes: tuple[np.ndarray, np.ndarray, np.ndarray]
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray


def words_of(some: list[str]) -> Words:
    lower = [text.lower() for text in some]
    points = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = letters()
    inside = table[np.minimum(points, len(table) - 1)]
    c = np.where(inside, points, 0).astype(np.uint64)
    at = np.flatnonzero(inside)
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    padded = np.concatenate((np.zeros(2, np.uint64), c, np.zeros(3, np.uint64)))
    before, here, after, later = padded[at + 1], padded[at + 2], padded[at + 3], padded[at + 4]
    later = np.where(after == 0, U(0), later)  # nothing of the next word
    three = (before * U(1 << 21) + here) * U(1 << 21) + after
    grams = scrambled(three, 1), scrambled(three * U(0x100000001B3) + later, 2)
    length = end - start
    s, e = start + 2, end + 2
    head = (padded[s] * U(1 << 21) + padded[s + 1]) * U(1 << 21) + np.where(length > 2, padded[s + 2], U(0))
    tail = (padded[e - 1] * U(1 << 21) + np.where(length > 1, padded[e - 2], U(0))) * U(1 << 21) + np.where(length > 2, padded[e - 3], U(0))
    offset = np.arange(len(points), dtype=np.uint64)
    place = offset - np.repeat(start, length).astype(np.uint64)[np.cumsum(inside) - 1] if len(start) else offset
    weight = (place + U(1)) * U(0x2545F4914F6CDD1D)
    whole = np.add.reduceat(c * (weight ^ (weight >> U(31))), start) if len(start) else np.zeros(0, np.uint64)
    starts = np.concatenate(([0], np.cumsum(length)))[:-1]
    bounds = np.cumsum([0, *[len(text) + 1 for text in lower]])
    counts = np.diff(np.searchsorted(start, bounds))
    return Words(grams, (scrambled(head, 3), scrambled(tail, 4), scrambled(whole, 5)), starts, length, counts)


def chains(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Probabilities of each word's label by forward-backward, over many texts at once.

    emission: log scores, words in text order; counts: words per text. With pairs, also the
    expected number of each transition.
    """
    n_labels = emission.shape[1]
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    offset = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    move, forward, backward = np.exp(transition), np.empty_like(e), np.empty_like(e)
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts longer than t
    last = np.exp(begin)[None, :].repeat(len(order), axis=0)
    for t in range(steps):
        rows = offset[: active[t]] + t
        now = (last[: active[t]] @ move if t else last) * e[rows]
        now /= now.sum(axis=1, keepdims=True)
        forward[rows] = now
        last = now
    back = np.ones((len(order), n_labels))
    expected = np.zeros((n_labels, n_labels))
    for t in range(steps - 1, -1, -1):
        k = active[t]
        rows = offset[:k] + t
        backward[rows] = back[:k]
        if t:
            ahead = back[:k] * e[rows]
            if pairs:
                both = forward[rows - 1][:, :, None] * move[None] * ahead[:, None, :]
                expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            earlier = ahead @ move.T
            earlier /= earlier.sum(axis=1, keepdims=True)
            back[:k] = earlier
    out = forward * backward
    out /= out.sum(axis=1, keepdims=True)
    return (out, expected) if pairs else out


@dataclass
class Model:
    """Languages, weights by feature and language, transition and begin scores."""

    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    begin: np.ndarray

    def emission(self, words: Words) -> np.ndarray:
        w = self.weights
        if not len(words.starts):
            return np.zeros((0, w.shape[1]), np.float32)
        score = np.add.reduceat(w[words.grams[0]] + w[words.grams[1]], words.starts, axis=0)
        for whole in words.wholes:
            score += w[whole]
        return score

    def label(self, some: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Letters of each word and words of each text, and each word's probabilities."""
        lengths, counts, emission = [], [], []
        for part in slices(some, most=TOGETHER):
            words = words_of(part)
            lengths.append(words.lengths)
            counts.append(words.counts)
            emission.append(self.emission(words))  # no part's features outlive it
        counts = np.concatenate(counts)
        return (np.concatenate(lengths), counts), chains(np.concatenate(emission), counts, self.transition, self.begin)

    def predict(self, some: list[str]) -> tuple[list[str], list[float]]:
        languages, scores = [], []
        for group in slices(some, most=CHAINS):
            (lengths, counts), share = self.label(group)
            letters_of = lengths.astype(float)
            upto = np.concatenate((np.zeros((1, share.shape[1])), np.cumsum(share * letters_of[:, None], axis=0)))
            ends = np.cumsum(counts)
            total = upto[ends] - upto[ends - counts]
            best = total.argmax(axis=1)
            whole = total.sum(axis=1)
            for i, n in enumerate(counts.tolist()):
                languages.append(self.languages[best[i]] if n else UNDETERMINED)
                scores.append(min(1.0, max(0.0, float(total[i, best[i]] / whole[i]))) if n else 0.0)
        return languages, scores


def fit_model(some: list[str], langs: list[str], rounds: int = 12, rate: float = 0.2, seed: int = 11) -> Model:
    """Maximum likelihood by adaptive gradient steps, over sequences that each hold texts of several languages."""
    names = sorted(set(langs))
    n_labels = len(names)
    order = np.random.default_rng(seed).permutation(len(some))
    parts = [words_of([some[i]]) for i in order]
    label = np.concatenate([np.full(int(p.counts[0]), names.index(langs[i])) for p, i in zip(parts, order)])
    # four texts to a sequence
    counts = np.array([sum(int(p.counts[0]) for p in parts[k : k + 4]) for k in range(0, len(parts), 4)])
    shift = np.cumsum([0, *[len(p.grams[0]) for p in parts]])
    words = Words(
        tuple(np.concatenate([p.grams[k] for p in parts]) for k in range(2)),
        tuple(np.concatenate([p.wholes[k] for p in parts]) for k in range(3)),
        np.concatenate([p.starts + s for p, s in zip(parts, shift)]),
        np.concatenate([p.lengths for p in parts]),
        counts,
    )
    first = (np.cumsum(counts) - counts)[counts > 0]
    model = Model(names, np.zeros((1 << BITS, n_labels), np.float32), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    truth = np.eye(n_labels)[label]
    follows = np.ones(len(label), bool)
    follows[first] = False
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (label[:-1][follows[1:]], label[1:][follows[1:]]), 1.0)
    squares, squares_t = np.zeros(model.weights.shape), np.full((n_labels, n_labels), 1e-8)
    letter_word = np.repeat(np.arange(len(words.starts)), words.lengths)
    for _ in range(rounds):
        share, expected = chains(model.emission(words), counts, model.transition, model.begin, pairs=True)
        error = (truth - share) / len(label)
        for k in range(n_labels):
            e = error[:, k]
            spread = e[letter_word]
            gradient = sum(np.bincount(g, weights=spread, minlength=1 << BITS) for g in words.grams)
            gradient += sum(np.bincount(g, weights=e, minlength=1 << BITS) for g in words.wholes)
            squares[:, k] += gradient**2
            model.weights[:, k] += rate * gradient / (np.sqrt(squares[:, k]) + 1e-9)
        gradient = (seen - expected) / len(label)
        squares_t += gradient**2
        model.transition += rate * gradient / np.sqrt(squares_t)
    return model


def train(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """Fit on at most most_rows rows of each lang; rows without lang or text are left out. None without rows."""
    known = docs.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most_rows).select("doc_id").distinct()
    # most_rows ids per language
    texts_of = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").join(F.broadcast(chosen), "doc_id")
    rows = sorted(texts_of.collect(), key=lambda r: (r.doc_id, r.lang, r.text))
    return fit_model([r.text for r in rows], [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights per language, whatever the input

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = texts(batch)
        lang, score = shared.value.predict(some) if shared.value else ([UNDETERMINED] * len(some), [0.0] * len(some))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
        )

    return map_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred and lang_score beside their own columns, which pass through the tasks untouched; columns
    of these names are replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    given, names = renamed(docs, ("text",))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*given.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType())

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        some = texts(batch)
        lang, score = shared.value.predict(some) if shared.value else ([UNDETERMINED] * len(some), [0.0] * len(some))
        columns = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "lang_score"])

    return map_arrow(given, rows, schema).select(*restored(names, ("lang_pred", "lang_score")), "lang_pred", "lang_score")
