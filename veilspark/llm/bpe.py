"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A piece of text (one match of the splitting pattern) is a row of bytes. A leaf per
byte position holds the rank of the pair that starts there, and each inner node
the smallest (rank, position) below it, so the root is the leftmost pair of least
rank. A merge changes three leaves, those of the merged token, of its right
neighbour (gone) and of its left one, each in O(log n): a piece of n bytes takes
O(n log n) steps, however long it is.

Text is cut into chunks (a space and what follows up to the next white space) whose
ends are ends of pattern matches, so a chunk is encoded without its surroundings.
Chunks met before come from a cache of bounded size; the pieces of all new chunks of
some documents are merged together, one tree per row of an array, so each step of
the loop is a step of every tree. Pieces over 64 bytes get a tree of their own.

Nulls and empty texts give no ids. The result depends on the text alone: repeated
rows, ties and further columns change nothing; the columns kept are named by the
caller.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veilspark.llm.shared import Known, map_arrow, slices, texts

#: Unicode White_Space, as the class of \s in the splitting pattern.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
#: Chunks kept per Python worker and half of the cache.
CACHE = 200_000
#: The largest tree that is a row of an array.
WIDEST = 64
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    find = ranks.get
    bits = (n - 1).bit_length()
    size = 1 << bits
    # node i has the children 2i and 2i+1; leaves start at size; a value is rank << bits | position
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    start_of_next = list(range(1, n + 1))  # by the start of a live token
    start_of_last = list(range(-1, n))
    mask = size - 1

    def put(position: int, value: int) -> None:
        i = size + position
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            value = value if value < other else other
            if tree[i] == value:
                return
            tree[i] = value

    while tree[1] != NONE:
        at = tree[1] & mask
        gone = start_of_next[at]
        after = start_of_next[gone]
        start_of_next[at] = after
        put(gone, NONE)
        if after < n:
            start_of_last[after] = at
            rank = find(piece[at : start_of_next[after]])
            put(at, NONE if rank is None else rank << bits | at)
        else:
            put(at, NONE)
        before = start_of_last[at]
        if before >= 0:
            rank = find(piece[before:after])
            put(before, NONE if rank is None else rank << bits | before)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : start_of_next[at]]])
        at = start_of_next[at]
    return ids


class Pairs:
    """Ranks of pairs of tokens, for arrays of them."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[token[:i]] << 32 | ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        self.keys, self.ranks = np.array(sorted(pairs) or [(-1, 0)], np.int64).T.copy()
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two make no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def value(self, left: np.ndarray, right: np.ndarray, position: np.ndarray, bits: int) -> np.ndarray:
        rank = self.rank(left, right)
        return np.where(rank == NONE, NONE, rank << bits | position)


def merge_pieces(pieces: list[bytes], pairs: Pairs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of 2 to `size` bytes, one after the other, and how many each has; size: a power of two."""
    m, bits = len(pieces), size.bit_length() - 1
    length = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)
    column = np.arange(size)
    live = column < length[:, None]
    ids = pairs.bytes[raw]
    tree = np.full((m, 2 * size), NONE)
    tree[:, size : 2 * size - 1] = pairs.value(ids[:, :-1], ids[:, 1:], column[:-1], bits)
    tree[:, size:][:, :-1][~live[:, 1:]] = NONE
    for level in range(bits, 0, -1):
        first = 1 << (level - 1)
        tree[:, first : 2 * first] = np.minimum(tree[:, 2 * first : 4 * first : 2], tree[:, 2 * first + 1 : 4 * first : 2])
    # neighbours by the start of a live token; column `size` stands for none
    right = np.tile(np.arange(1, size + 2), (m, 1))
    left = np.tile(np.arange(-1, size), (m, 1))
    tree, ids, right, left = tree.ravel(), ids.ravel(), right.ravel(), left.ravel()
    row = np.flatnonzero(tree[1 :: 2 * size] != NONE)
    while len(row):
        top = tree[row * 2 * size + 1]
        at, cell, link = top & (size - 1), row * size, row * (size + 1)
        gone = right[link + at]
        after = right[link + gone]
        before = left[link + at]
        right[link + at] = after
        left[link + after] = at
        live.ravel()[cell + gone] = False
        merged = top >> bits
        ids[cell + at] = merged
        inside = after < length[row]
        new = np.where(inside, pairs.value(merged, ids[cell + np.where(inside, after, 0)], at, bits), NONE)
        some = before >= 0
        old = np.where(some, pairs.value(ids[cell + np.where(some, before, 0)], merged, before, bits), NONE)
        node = np.concatenate((size + gone, size + at, (size + before)[some]))
        base = np.concatenate((row, row, row[some])) * (2 * size)
        tree[base + node] = np.concatenate((np.full(len(row), NONE), new, old[some]))
        for _ in range(bits):
            child = base + (node & ~1)
            node >>= 1
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
        row = row[tree[row * 2 * size + 1] != NONE]
    return ids.reshape(m, size)[live], live.sum(axis=1)


class Codec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]"))
        self.known = Known(self._chunks, CACHE)

    def _part(self, ids: list[int]) -> tuple[str, int, bytes]:
        return " ".join([self.names[i] for i in ids]), len(ids), b"".join([self.tokens[i] for i in ids])

    def _pieces(self, pieces: set[str]) -> dict[str, tuple[str, int, bytes]]:
        found, by_size, whole, part = {}, {}, self.ranks.get, self._part
        for piece in pieces:
            raw = piece.encode()
            if (rank := whole(raw)) is not None:
                found[piece] = part([rank])
            elif len(raw) > WIDEST:
                found[piece] = part(merge_piece(raw, self.ranks))
            else:
                names, rows = by_size.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), ([], []))
                names.append(piece)
                rows.append(raw)
        for size, (names, rows) in by_size.items():
            flat, counts = merge_pieces(rows, self.pairs, size)
            flat, end = flat.tolist(), 0
            for name, n in zip(names, counts.tolist()):
                found[name] = part(flat[end : end + n])
                end += n
        return found

    def _chunks(self, chunks: list[str]) -> list[tuple[str, int, bytes]]:
        split = list(map(self.split.findall, chunks))
        parts = self._pieces({piece for pieces in split for piece in pieces})
        out = []
        for pieces in split:
            if len(pieces) == 1:
                out.append(parts[pieces[0]])
            else:
                ids, n, decoded = zip(*[parts[piece] for piece in pieces])
                out.append((" ".join(ids), sum(n), b"".join(decoded)))
        return out

    def _parts(self, some: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """For each text, its chunks as (ids as text, number of ids, bytes that these ids decode to)."""
        out = []
        for part in slices(some):
            chunks = [CHUNK.findall(text) for text in part]
            known = self.known.of({chunk for row in chunks for chunk in row})
            out += [list(map(known.__getitem__, row)) for row in chunks]
        return out

    def encode(self, some: list[str]) -> list[list[int]]:
        return [[int(i) for part in row for i in part[0].split()] for row in self._parts(some)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, some: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, hash of the ids as text, hash of the bytes that the ids decode to."""
        return [
            (
                sum([p[1] for p in row]),
                hashlib.sha256(" ".join([p[0] for p in row]).encode()).hexdigest(),
                hashlib.sha256(b"".join([p[2] for p in row])).hexdigest(),
            )
            for part in slices(some)
            for row in self._parts(part)
        ]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) for each row."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array(codec(path, pattern).encode(texts(batch)), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(key), ids], [key, "ids"])

    return map_arrow(docs.select(key, "text"), rows, f"{key} {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text) for rows of (key, ids); bytes that are no UTF-8 become replacement characters; null ids give null."""
    kind = encoded.schema[key].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = codec(path, pattern).decode
        text = [None if ids is None else decode(ids).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(text, pa.string())], [key, "text"])

    return map_arrow(encoded.select(key, "ids"), rows, f"{key} {kind}, text string")


def encode_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): a round trip of every text, as digests."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded = zip(*codec(path, pattern).digests(texts(batch)))
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(docs.select(key, "text"), rows, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
