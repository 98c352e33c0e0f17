"""64-bit hashes of the words of many texts at once, from their UTF-8 bytes.

Words are runs of anything but ASCII white space. A word's hash is a polynomial in
its bytes, taken as a difference of prefix sums, then mixed; so a batch of texts
costs a few passes over its bytes and no step per word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
POWERS = 1 << 16

_random = np.random.default_rng(20240607)
_BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class BatchWords:
    """Word hashes of a list of UTF-8 texts; of(i) gives those of text i, in order.

    apart: for each byte, whether it stands between words (the line feed must). data holds all texts, start and end the
    words' places in it, origin the places of the texts.
    """

    def __init__(self, raw: list[bytes], lower: bool = False, apart: np.ndarray = _SPACE):
        joined = b"\n".join(raw) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        if lower:
            data = _LOWER[data]
        space = apart[data]
        edge = np.diff(np.concatenate(([1], space)).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(BASE, n), dtype=np.uint64, out=sums[1:])
        shift = _powers(pow(BASE, -1, 1 << 64), n)
        self.hashes = mix((sums[end] - sums[start]) * shift[start] + (end - start).astype(np.uint64))
        self.data, self.start, self.end = data, start, end
        self.origin = np.cumsum([0, *[len(x) + 1 for x in raw]])
        self.bounds = np.searchsorted(start, self.origin)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows; of the whole sequence where it is shorter; none without words."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, U(size))
    for k in range(size):
        out = mix(out * U(3) + words[k : len(words) - size + 1 + k])
    return out


def repeated_trigram_words(words: np.ndarray) -> int:
    """Words that stand in 3-word windows found twice or more in the text."""
    if len(words) < 3:
        return 0
    windows = shingles(words, 3)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words), bool)
    at = order[twice]
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())
