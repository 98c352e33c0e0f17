"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are normalised to words: A-Z in lower case, then runs of letters a-z, digits and
anything outside ASCII. Items are dealt out to tasks, each of which builds automata
over the words of its items, of at most BLOCK words apiece; a longer item is cut into
pieces that overlap by a window less one word, so no window is lost. An automaton goes
to all tasks as a table of bounded size, ROUND of them at a time; more items mean more
passes over the documents, not larger broadcasts.

A document's words are streamed through each automaton, which holds the longest suffix
read so far that is part of an item. Where it is as long as a window, the state names
the items that hold that window. An item shorter than a window is a window of its own;
its state accepts it whenever the suffix is at least as long. What cannot match is not
streamed: words whose grams (of four, or of a shorter item's length) are in no item,
by a table of hash bits that may let through too much and never too little. Words are
compared as text inside the automaton, never by hash alone.

Spans are maximal runs of words inside occurring windows. decontaminate() removes spans
of `least_span` words and more, and documents of which a larger share than `coverage`
lies in spans.

A null or empty text has no words, an item without words no windows. Repeated items
and documents are matched each by itself. Rows of items without an id mark words, but
are neither counted nor named. Further columns of the documents pass through, whatever
their names; those of the items are ignored. Without items nothing is hit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import map_arrow, slices, stored
from veilspark.llm.wordhash import BatchWords, shingles

U = np.uint64
#: Words to an automaton, and automata that go to all tasks at a time (at most about 40 bytes a word each).
BLOCK, ROUND = 100_000, 4
#: Words to a gram of the table that picks what is streamed, and bits of that table.
GRAM, TABLE = 4, 22
#: Bytes between words, once A-Z are in lower case.
APART = np.zeros(256, bool)
APART[:0x80] = True
APART[0x30:0x3A] = APART[0x61:0x7B] = False


@dataclass(frozen=True)
class Limits:
    """Words to a window; words from which on a span is removed; share of hit words beyond which a document goes."""

    window: int = 10
    least_span: int = 10
    coverage: float = 0.5


class Builder:
    """A generalised suffix automaton of sequences of word numbers, grown word by word."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the shorter strings of q that p reaches by c."""
        half = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[half], self.link[q] = self.link[q], half
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = half
            p = self.link[p]
        return half

    def _fits(self, p: int, c: int) -> int:
        """The state that p reaches by c, holding no strings longer by more than that word."""
        q = self.next[p][c]
        return q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)

    def add(self, words: list[int]) -> None:
        last = 0
        for c in words:
            if c in self.next[last]:
                last = self._fits(last, c)
                continue
            new, p = self._state(self.length[last] + 1, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            self.link[new] = self._fits(p, c) if p >= 0 else 0
            last = new


def build(items: list[tuple[str | None, list[bytes], bool]], window: int) -> bytes:
    """The automaton of pieces (item id, words, whether the item is that piece alone), packed."""
    vocabulary: dict[bytes, int] = {}
    numbered = [(name, [vocabulary.setdefault(w, len(vocabulary)) for w in words], whole) for name, words, whole in items]
    made = Builder()
    for _, words, _ in numbered:
        made.add(words)
    names: dict[str | None, int] = {}
    holds: dict[int, set] = {}
    accepts: dict[int, set] = {}
    grams: dict[int, list] = {}
    for (name, words, whole), (_, texts, _) in zip(numbered, items):
        own, state = names.setdefault(name, len(names)), 0
        for at, c in enumerate(words):
            state = made.next[state][c]
            if at >= window and made.length[made.link[state]] >= window:
                state = made.link[state]
            if at + 1 >= window:
                holds.setdefault(state, set()).add(own)
        if whole and len(words) < window:
            accepts.setdefault(state, set()).add((len(words), own))
        size = min(GRAM, len(words), window)
        grams.setdefault(size, []).append(shingles(BatchWords([b" ".join(texts)], apart=APART).hashes, size))
    shortest = min((min(len(words), window) for _, words, whole in numbered if whole), default=window)
    width = len(vocabulary)
    moves = [(state * width + c, to) for state, to_by in enumerate(made.next) for c, to in to_by.items()]
    arrays = {
        "keys": np.array([k for k, _ in moves], np.int64), "to": np.array([t for _, t in moves], np.int32),
        "link": np.array(made.link, np.int32), "length": np.array(made.length, np.int32),
    }
    rest = {"words": list(vocabulary), "names": list(names), "holds": holds, "accepts": accepts, "window": window, "shortest": shortest}
    return pickle.dumps(arrays | rest | {"grams": {n: np.unique(np.concatenate(g)) for n, g in grams.items()}})


class Automaton:
    """A packed automaton, ready to read documents."""

    def __init__(self, packed: bytes):
        it = pickle.loads(packed)
        self.window, self.names, self.holds = it["window"], it["names"], it["holds"]
        self.words = {w: i for i, w in enumerate(it["words"])}
        self.moves = dict(zip(it["keys"].tolist(), it["to"].tolist()))
        self.link, self.length = it["link"].tolist(), it["length"].tolist()
        self.shortest = it["shortest"]
        # per state, by growing length: the state of its suffix of a window's length, and the nearest suffix that is a short item
        self.top, self.short = [-1] * len(self.link), [-1] * len(self.link)
        for v in np.argsort(it["length"], kind="stable").tolist()[1:]:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.top[v] = v if self.length[up] < self.window else self.top[up]
            self.short[v] = up if up in it["accepts"] else self.short[up]
        self.accepts = {v: sorted(pairs) for v, pairs in it["accepts"].items()}
        self.tables = {}
        for size, grams in it["grams"].items():
            self.tables[size] = np.zeros(1 << TABLE, bool)
            self.tables[size][(grams >> U(64 - TABLE)).astype(np.int64)] = True

    def runs(self, batch: BatchWords) -> list[tuple[int, int]]:
        """Stretches [a, b) of a batch's words that may hold a window; each lies in one text."""
        n = len(batch.hashes)
        found = np.zeros(n + 1, np.int8)
        for size, table in self.tables.items():
            if n < size:
                continue
            hit = table[(shingles(batch.hashes, size) >> U(64 - TABLE)).astype(np.int64)]
            ends = batch.bounds[1:]
            for k in range(1, size):
                across = ends - k
                hit[across[(across >= 0) & (across < len(hit))]] = False
            at = np.flatnonzero(hit)
            for k in range(size):
                found[at + k] = 1
        if not found.any():
            return []
        edge = np.diff(np.concatenate(([0], found)))
        # a text's end ends a run
        begins = np.union1d(np.flatnonzero(edge == 1), batch.bounds[:-1][found[batch.bounds[:-1]] == 1])
        stops = np.union1d(np.flatnonzero(edge == -1), begins[1:][found[begins[1:] - 1] == 1])
        long = stops - begins >= self.shortest
        return list(zip(begins[long].tolist(), stops[long].tolist()))

    def read(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Spans [begin, end) of words inside occurring windows, the items of these windows, the longest match."""
        spans, items, longest, state, n = [], set(), 0, 0, 0
        number, moves, link, length, width = self.words.get, self.moves.get, self.link, self.length, len(self.words)
        for at, word in enumerate(words):
            c = number(word)
            if c is None:
                state = n = 0
                continue
            to = moves(state * width + c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = moves(state * width + c)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            longest = max(longest, n)
            hit = 0
            if n >= self.window:
                hit = self.window
                items |= self.holds[self.top[state]]
            if self.accepts:
                hit = max(hit, self._short(state, n, items))
            if hit:
                begin = at + 1 - hit
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at + 1))
        return spans, items, longest

    def _short(self, state: int, n: int, items: set[int]) -> int:
        """Adds the short items that end here; the length of the longest."""
        most = 0
        while state > 0:
            for size, item in self.accepts.get(state, ()):
                if size <= n:
                    items.add(item)
                    most = max(most, size)
            state = self.short[state]
        return most


@lru_cache(maxsize=ROUND)
def automaton(packed: bytes) -> Automaton:
    return Automaton(packed)


def item_words(text: str | None) -> list[bytes]:
    batch = BatchWords([(text or "").encode()], lower=True, apart=APART)
    flat = batch.data.tobytes()
    return [flat[a:b] for a, b in zip(batch.start.tolist(), batch.end.tolist())]


def automata(items: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """(part, at, packed): automata of at most `block` words (a window at least) over items (item_id, text)."""
    block = max(block, 2 * window)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = item_words(text)
                for a in range(0, max(len(words) - window + 1, min(len(words), 1)), block - window + 1):
                    piece = words[a : a + block]
                    if size + len(piece) > block and held:
                        yield packed(held)
                        held, size = [], 0
                    held.append((name, piece, len(piece) == len(words)))
                    size += len(piece)
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([build(held, window)], pa.binary())], ["packed"])

    own = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word and what follows it take two bytes at least, six as a rule
    dealt = own.repartition(max(1, -(-total // (6 * block))))
    return dealt.mapInArrow(made, "packed binary").select(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "packed"
    )


LEAK = "struct<n_words:int,n_hit:int,longest:int,spans:array<struct<begin:int,end:int>>,items:array<string>>"
_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_KINDS = {"n_words": pa.int32(), "n_hit": pa.int32(), "longest": pa.int32(), "spans": _SPANS, "items": pa.list_(pa.string())}


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for begin, end in sorted(spans):
        if out and out[-1][1] >= begin:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def read_texts(raw: list[bytes], some: list[Automaton]) -> Iterator[tuple[int, dict[int, tuple[list, set, int]]]]:
    """Word counts of each part of the texts' list, and per text with a run of it: spans, item names, longest match."""
    for part in slices(raw, most=1_000_000):
        batch = BatchWords(part, lower=True, apart=APART)
        found: dict[int, tuple[list, set, int]] = {}
        for one in some:
            for a, b in one.runs(batch):
                text = int(np.searchsorted(batch.bounds, a, "right")) - 1
                first, last = int(batch.start[a]), int(batch.end[b - 1])
                flat = batch.data[first:last].tobytes()
                words = [flat[x:y] for x, y in zip((batch.start[a:b] - first).tolist(), (batch.end[a:b] - first).tolist())]
                spans, items, longest = one.read(words)
                if longest:
                    own = found.setdefault(text, ([], set(), 0))
                    shift = a - int(batch.bounds[text])
                    own[0].extend((x + shift, y + shift) for x, y in spans)
                    own[1].update(one.names[i] for i in items)
                    found[text] = (own[0], own[1], max(own[2], longest))
        yield np.diff(batch.bounds).tolist(), found


def leaks(docs: DataFrame, items: DataFrame, limits: Limits = Limits(), name: str = "leak", block: int = BLOCK) -> DataFrame:
    """The documents with a struct column `name`: n_words, n_hit, longest (match found in what was streamed), spans, items.

    spans count words, [begin, end); items holds the ids as text, each once, sorted. A column of that name is replaced.
    """
    columns = [c for c in docs.columns if c != name]
    table = stored(automata(items, limits.window, block), "automata")
    keys = [(r["part"], r["at"]) for r in table.select("part", "at").orderBy("part", "at").collect()]
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(columns))
    now = docs.select(*columns).toDF(*[f"c{i}" for i in range(len(columns))])
    text, spark = f"c{columns.index('text')}", docs.sparkSession
    for first in range(0, max(len(keys), 1), ROUND):
        few = keys[first : first + ROUND]
        packed = [r["packed"] for r in table.join(spark.createDataFrame(few, "part int, at long"), ["part", "at"]).collect()] if few else []
        if first:
            now = stored(now, "leaks")
        now = _round(now, text, kinds, spark.sparkContext.broadcast(packed))
    return now.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_leak").alias(name))


def _round(now: DataFrame, text: str, kinds: str, shared) -> DataFrame:
    """One pass of the documents through some automata; what earlier passes found is carried along."""
    earlier = "_leak" in now.columns

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(text).cast(pa.binary())]
        some = [automaton(p) for p in shared.value]
        before = batch.column("_leak").to_pylist() if earlier else None
        out, at = [], 0
        for counts, found in read_texts(raw, some):
            for i, n in enumerate(counts):
                spans, names, longest = found.get(i, ((), (), 0))
                if before:
                    old = before[at + i]
                    spans = [*spans, *((s["begin"], s["end"]) for s in old["spans"])]
                    names, longest = {*names, *old["items"]}, max(longest, old["longest"])
                spans = united(spans) if spans else []
                out.append((n, sum(b - a for a, b in spans), longest, spans, sorted(x for x in names if x is not None)))
            at += len(counts)
        out = [(n, hit, longest, [{"begin": a, "end": b} for a, b in spans], names) for n, hit, longest, spans, names in out]
        parts = [pa.array(values, kind) for values, kind in zip(zip(*out), _KINDS.values())]
        found = pa.StructArray.from_arrays(parts, fields=[pa.field(*f) for f in _KINDS.items()])
        kept = [c for c in batch.schema.names if c != "_leak"]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found], [*kept, "_leak"])

    return map_arrow(now, rows, f"{kinds}, _leak {LEAK}")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the characters from each span's first word to its last."""
    batch, out, at = BatchWords([text], lower=True, apart=APART), [], 0
    for begin, end in spans:
        out.append(text[at : batch.start[begin]])
        at = int(batch.end[end - 1])
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents, same columns, without spans of items; documents mostly made of them are left out."""
    columns, mark = docs.columns, "leak" + "_" * max(map(len, docs.columns))
    marked = leaks(docs, items, limits, mark)
    marked = marked.filter(F.col(f"{mark}.n_hit") <= F.col(f"{mark}.n_words") * limits.coverage)
    long = F.filter(f"{mark}.spans", lambda s: s["end"] - s["begin"] >= limits.least_span)
    inner = [f"c{i}" for i in range(len(columns))]
    ready = marked.select(*columns, long.alias(mark)).toDF(*inner, "spans")
    text = columns.index("text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [
            without_spans(t.encode(), [(s["begin"], s["end"]) for s in spans]).decode() if spans else t
            for t, spans in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist())
        ]
        arrays = [pa.array(values, pa.string()) if i == text else batch.column(i) for i in range(len(inner))]
        return pa.RecordBatch.from_arrays(arrays, inner)

    kinds = ", ".join(f"{i} {docs.schema[c].dataType.simpleString()}" for i, c in zip(inner, columns))
    return map_arrow(ready, cut, kinds).toDF(*columns)
