"""Where terms of a table of any size stand in texts.

A text is a row of runs: words, and what stands between them. A term is cut the same
way; its shape is `(ahead, n_runs, behind, starts_word)`: the runs that it holds whole,
and how many characters of a run it takes at either end. A text is walked once over its
runs. A bitmap, sized by the number of terms, says of each run whether a term's first
run is like it, then whether one of that shape begins so, then whether the whole slice
may be a term. Only what passes leaves the row, so an exchange holds about as many rows
as there are hits, however many words the texts have and however long a term is. An
equi-join with the terms decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.rowsql import column, each, each_at, empty, keep, let, lit, some, struct
from veilspark.functions.spans import run_blocks, run_start, runs_of
from veilspark.functions.text import RUNS, WORD

SHAPE = "struct<ahead:int,n_runs:int,behind:int,starts_word:boolean>"
#: Bits for each of the three marks of a term, and bits to a byte (bytes stay ASCII). A bitmap is never larger than
#: MOST_BYTES, enough for about two million terms; with more, more slices leave their row in vain, and the join drops them.
BITS_PER_MARK, PER_BYTE, MOST_BYTES = 16, 7, 16 << 20
IS_WORD = f"^[{WORD}]"


def with_shape(terms: DataFrame, aligned: bool = False) -> DataFrame:
    """Add `shape` and `first`, the run by which a term is found, to rows with `term`.

    A term's edges may cut a run between words; a term without a word has its length as `behind` and no run. An aligned
    term must stand between word boundaries, so it holds whole runs only.
    """
    term = F.col("term")
    if aligned:
        head, core, starts = F.lit(""), term, term.rlike(IS_WORD)
    else:
        starts = term.rlike(f"[{WORD}]")
        head = F.when(starts, F.regexp_extract(term, f"^[^{WORD}]*", 0)).otherwise("")
        core = F.regexp_extract(term, f"[{WORD}](?:(?s:.*)[{WORD}])?", 0)
    cut = terms.withColumns({"_head": F.length(head), "_core": core}).withColumn("_runs", F.regexp_extract_all("_core", F.lit(RUNS), F.lit(0)))
    shape = F.struct(
        F.col("_head").alias("ahead"), F.size("_runs").alias("n_runs"), (F.length(term) - F.col("_head") - F.length("_core")).alias("behind"),
        starts.alias("starts_word"),
    ).cast(SHAPE)
    return cut.withColumns({"shape": shape, "first": F.coalesce(F.get("_runs", F.lit(0)), F.lit(""))}).drop("_head", "_core", "_runs")


def _marks(salt: str, first: str, shape: str, whole: str) -> list[str]:
    """SQL: the three hashes that mark a term: of its first run, of that and its shape, of all of it."""
    parts = f"{shape}.ahead, {shape}.n_runs, {shape}.behind, {shape}.starts_word"
    return [f"xxhash64(0, {salt}, {first})", f"xxhash64(1, {salt}, {first}, {parts})", f"xxhash64(2, {salt}, {whole})"]


def _marked(bits: str, mark: str) -> str:
    """SQL: two bits of the bitmap are set."""

    def is_set(at: str) -> str:
        return let(at, lambda p: f"shiftright(ascii(CAST(substring({bits}, CAST({p} div {PER_BYTE} AS int) + 1, 1) AS string)), CAST({p} % {PER_BYTE} AS int)) & 1") + " = 1"

    size = f"({PER_BYTE}L * octet_length({bits}))"
    return let(mark, lambda h: f"{is_set(f'pmod({h}, {size})')} AND {is_set(f'pmod(shiftright({h}, 20), {size})')}")


def bitmap(terms: DataFrame, fold: Callable[[str], str], salt: str = "0") -> Column:
    """The marks of all terms (rows with term, shape, first and what salt names) as a constant, bits in the lower half of bytes."""
    hashes = terms.select(F.explode(F.expr(f"array({', '.join(_marks(salt, fold('first'), 'shape', fold('term')))})")).alias("h"))
    n_bytes = min(MOST_BYTES, max(128, terms.count() * 3 * BITS_PER_MARK // PER_BYTE))
    bits = hashes.select(F.explode(F.array(F.col("h"), F.shiftright("h", 20))).alias("h")).select(F.pmod("h", F.lit(PER_BYTE * n_bytes)).alias("at"))
    used = bits.groupBy(F.expr(f"at div {PER_BYTE}").alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1, CAST(at % {PER_BYTE} AS int))")).alias("b")).toArrow()
    out = np.zeros(n_bytes, np.uint8)
    out[used["id"].to_numpy()] = used["b"].to_numpy()
    return F.lit(out.tobytes())


def shapes_of(terms: DataFrame) -> Column:
    """array of the distinct shapes, as a value of one subquery."""
    return terms.agg(F.array_sort(F.collect_set("shape"))).scalar()


HIT = "struct<start:int,end:int,text:string>"
_CUT = "struct<i:int,shift:int,text:string>"


def places(text: Column, shapes: Column, bits: Column, fold: Callable[[str], str] = lambda v: v, salt: Column | None = None) -> Column:
    """array<struct<start,end,text>>: slices of the text that may be terms and stand as their shape asks.

    A slice that begins (ends) inside a run between words needs a character of it beyond the slice, or the text's edge.
    """

    def found(t: str, all_shapes: str, bitmap_: str, salt_: str) -> str:
        def marked(number: int, first: str, shape: str, whole: str) -> str:
            return _marked(bitmap_, _marks(salt_, first, shape, whole)[number])

        def at_run(r: str, i: str, runs: str, first_is_word: str, others: str) -> str:
            is_word = f"(({i} % 2 = 0) = {first_is_word})"

            def candidate(shape: str) -> str:
                prev, after, stop = f"get({runs}, {i} - 1)", f"get({runs}, {i} + {shape}.n_runs)", f"{i} + {shape}.n_runs"
                ends_word = f"({shape}.starts_word = ({shape}.n_runs % 2 = 1))"
                ahead = f"({shape}.ahead = 0 AND ({shape}.starts_word OR {i} > 0) OR {shape}.ahead > 0 AND length({prev}) + CASE WHEN {i} = 1 THEN 1 ELSE 0 END > {shape}.ahead)"
                room = f"length({after}) + CASE WHEN {stop} = size({runs}) - 1 THEN 1 ELSE 0 END"
                behind = f"({shape}.behind = 0 AND ({ends_word} OR {stop} < size({runs})) OR {shape}.behind > 0 AND {room} > {shape}.behind)"
                whole = f"array_join(slice({runs}, {i} + 1, {shape}.n_runs), '')"
                text_ = (
                    f"concat(CASE WHEN {shape}.ahead > 0 THEN right({prev}, {shape}.ahead) ELSE '' END, {whole}, "
                    f"CASE WHEN {shape}.behind > 0 THEN left({after}, {shape}.behind) ELSE '' END)"
                )
                made = f"CAST({struct(i=i, shift=f'-{shape}.ahead', text=text_)} AS {_CUT})"
                return f"CASE WHEN {stop} <= size({runs}) AND {ahead} AND {behind} THEN {made} END"

            def of_run(f: str) -> str:
                begins = lambda shape: f"{shape}.n_runs > 0 AND {shape}.starts_word = {is_word} AND {marked(1, f, shape, f)}"
                return f"CASE WHEN {marked(0, f, 'NULL', f)} THEN {each(keep(all_shapes, begins), candidate)} ELSE {empty(_CUT)} END"

            # few terms begin between words; where none does, only words are looked at
            return f"CASE WHEN {others} OR {is_word} THEN {let(fold(r), of_run)} ELSE {empty(_CUT)} END"

        def wordless(r: str, i: str, runs: str) -> str:
            """Slices of a run between words, for terms without a word."""

            def at(shape: str) -> str:
                first = f"CASE WHEN {i} = 0 THEN 0 ELSE 1 END"
                last = f"length({r}) - {shape}.behind - CASE WHEN {i} = size({runs}) - 1 THEN 0 ELSE 1 END"
                cut = lambda o: f"CAST({struct(i=i, shift=o, text=f'substring({r}, {o} + 1, {shape}.behind)')} AS {_CUT})"
                return f"CASE WHEN {last} >= {first} THEN {each(f'sequence({first}, {last})', cut)} ELSE {empty(_CUT)} END"

            return f"CASE WHEN {r} RLIKE {lit(IS_WORD)} THEN {empty(_CUT)} ELSE flatten({each(keep(all_shapes, lambda s: f'{s}.n_runs = 0'), at)}) END"

        def walked(runs: str) -> str:
            def hits(first_is_word: str, others: str) -> str:
                whole = f"flatten({each_at(runs, lambda r, i: at_run(r, i, runs, first_is_word, others))})"
                no_words = f"flatten({each_at(runs, lambda r, i: wordless(r, i, runs))})"
                has_wordless = some(all_shapes, lambda s: f"{s}.n_runs = 0")
                every = f"concat({whole}, CASE WHEN {has_wordless} THEN {no_words} ELSE {empty(_CUT)} END)"
                return keep(every, lambda c: f"{c} IS NOT NULL AND {let(fold(f'{c}.text'), lambda v: marked(2, v, 'NULL', v))}")

            def offsets(cuts: str) -> str:
                def placed(blocks: str) -> str:
                    return each(cuts, lambda c: let(f"{run_start(runs, blocks, f'{c}.i')} + {c}.shift", lambda at: struct(start=at, end=f"{at} + length({c}.text)", text=f"{c}.text")))

                return f"CASE WHEN size({cuts}) > 0 THEN {let(run_blocks(runs), placed)} ELSE {empty(HIT)} END"

            between = some(all_shapes, lambda s: f"{s}.n_runs > 0 AND NOT {s}.starts_word")
            return let(let(f"get({runs}, 0) RLIKE {lit(IS_WORD)}", lambda w: let(between, lambda o: hits(w, o))), offsets)

        inside = let(runs_of(t), lambda runs: f"CASE WHEN size({runs}) > 0 THEN {walked(runs)} ELSE {empty(HIT)} END")
        return f"CASE WHEN size({all_shapes}) > 0 THEN {inside} ELSE {empty(HIT)} END"

    return column(found, t=text, shapes=shapes, bits=bits, salt=F.lit(0) if salt is None else salt)
