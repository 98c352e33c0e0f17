"""Context words: a cue close before a match raises its score."""

from __future__ import annotations

from veilspark.functions.rowsql import keep, let, lit, some, strings
from veilspark.functions.text import WORD, segment_slice

WORDS_BEFORE = 5
# Fixed values of the public context scorer: raise, floor, cap.
BOOST, FLOOR, CAP = 0.35, 0.4, 1.0

_WINDOW = 512


def words(text: str) -> str:
    return keep(f"split(lower({text}), {lit(f'[^{WORD}]+')})", lambda w: f"{w} <> ''")


def last_words(segs: str, start: str, n: int = WORDS_BEFORE) -> str:
    """SQL: the last `n` words before `start`.

    A short window is enough unless it holds so few words that its first one may
    be cut; then the whole text before the match is used.
    """

    def tail(ws: str) -> str:
        return f"slice({ws}, greatest(1, size({ws}) - {n - 1}), {n})"

    window = words(segment_slice(segs, f"greatest(0, {start} - {_WINDOW})", start))
    whole = let(words(segment_slice(segs, "0", start)), tail)
    return let(
        window, lambda ws: f"CASE WHEN {start} <= {_WINDOW} OR size({ws}) > {n} THEN {tail(ws)} ELSE {whole} END"
    )


def cue_lists(cues: tuple[str, ...]) -> tuple[str, str]:
    """SQL arrays of the one-word cues and of the phrases (padded by blanks)."""
    split_cues = [cue.lower().replace("-", " ").split() for cue in cues]
    return (
        strings(c[0] for c in split_cues if len(c) == 1),
        strings(f" {' '.join(c)} " for c in split_cues if len(c) > 1),
    )


def has_cue(before: str, single: str, phrases: str) -> str:
    """SQL: whether the words before a match hold a cue; a cue of several words
    must stand there as a phrase."""
    joined = f"concat(' ', array_join({before}, ' '), ' ')"
    return f"(arrays_overlap({before}, {single}) OR {some(phrases, lambda p: f'contains({joined}, {p})')})"


def boosted(score: str) -> str:
    return f"least({CAP}D, greatest({FLOOR}D, {score} + {BOOST}D))"
