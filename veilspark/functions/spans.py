"""Every match of a pattern, with offsets.

Spark has no built-in that returns match offsets. The matches come from
`regexp_extract_all`, the gaps between them from `split` on the same pattern;
a running sum of their lengths gives the start of each match in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rowsql import BLOCK, column, each, each_at, empty, fold_emit, fresh, let, lit, struct
from veilspark.functions.text import RUNS
from veilspark.schema import SPAN


def matches_of(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {pattern}, 0)"


def placed(text: str, pattern: str, matches: str) -> str:
    """SQL: the matches of `pattern` with their offsets."""

    def step(pos: str, item: str) -> tuple[str, str]:
        start = f"{pos} + {item}.gap"
        end = f"{start} + length({item}.text)"
        return end, f"array({struct(start=start, end=end, text=f'{item}.text')})"

    def offsets(gaps: str) -> str:
        items = each_at(matches, lambda m, i: struct(gap=f"length(get({gaps}, {i}))", text=m))
        return fold_emit(items, "0", step, "int", SPAN) + ".out"

    return let(f"split({text}, {pattern}, -1)", offsets)


def spans_of(text: str, pattern: str) -> str:
    """SQL of `spans`."""
    return let(
        matches_of(text, pattern),
        lambda ms: f"CASE WHEN size({ms}) > 0 THEN {placed(text, pattern, ms)} ELSE {empty(SPAN)} END",
    )


def runs_of(text: str) -> str:
    """SQL: the words of a text and what stands between them, as strings in order."""
    return f"regexp_extract_all({text}, {lit(RUNS)}, 0)"


def run_blocks(runs: str) -> str:
    """SQL: where every BLOCK-th run starts; `run_start` takes it from there, so no array of all offsets is made."""
    blocks = f"sequence(0, CAST((size({runs}) - 1) div {BLOCK} AS int))"
    sizes = each(blocks, lambda b: _characters(f"slice({runs}, {b} * {BLOCK} + 1, {BLOCK})"))
    return f"CASE WHEN size({runs}) > 0 THEN {fold_emit(sizes, '0', lambda at, n: (f'{at} + {n}', f'array({at})'), 'int', 'int')}.out ELSE {empty('int')} END"


def run_start(runs: str, blocks: str, i: str) -> str:
    """SQL: the offset of run i."""
    return f"get({blocks}, CAST({i} div {BLOCK} AS int)) + {_characters(f'slice({runs}, ({i} - {i} % {BLOCK}) + 1, {i} % {BLOCK})')}"


def _characters(runs: str) -> str:
    acc, r = fresh("acc"), fresh("r")
    return f"aggregate({runs}, 0, ({acc}, {r}) -> {acc} + length({r}))"


def spans(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,text>> of all non-overlapping matches, left to right.

    The pattern must not match the empty string. Only a text that does match pays
    for the `split`.
    """
    regex = pattern if isinstance(pattern, Column) else F.lit(pattern)
    return column(lambda t, p: spans_of(t, p), t=text, p=regex)


def guarded(hint: Column, value: Column, otherwise: Column) -> Column:
    """Run a costly expression only on rows that pass a cheap test."""
    return F.when(hint, value).otherwise(otherwise)


def no_spans() -> Column:
    return F.expr(empty(SPAN))
