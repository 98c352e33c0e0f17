"""Row-local logic as Spark SQL text.

The per-document logic is a nest of higher-order functions. Written as SQL text
it reaches the JVM in one call and is parsed there; built from Python Column
calls the same tree takes tens of thousands of round trips and seconds per plan.
Functions of this package that take and return `str` work on SQL operands; those
that take and return `Column` wrap them with `column`.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Appending to an array copies it. Emitting into blocks of this size keeps a fold
# over n items at about n * BLOCK / 2 + (n / BLOCK)^2 / 2 element copies, so a
# document with millions of findings stays cheap.
BLOCK = 128

_names = itertools.count()


def fresh(stem: str = "v") -> str:
    """A lambda variable name that is not in use elsewhere."""
    return f"{stem}_{next(_names)}"


def lit(value: str | None) -> str:
    """SQL string literal."""
    if value is None:
        return "CAST(NULL AS string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> str:
    """SQL array of string literals."""
    return f"CAST(array({', '.join(lit(v) for v in values)}) AS array<string>)"


def column(body: Callable[..., str], **args: Column) -> Column:
    """Column of a SQL expression over Column arguments, each evaluated once."""
    row = fresh("row")
    sql = body(*[f"{row}.{name}" for name in args])
    bound = F.array(F.struct(*[value.alias(name) for name, value in args.items()]))
    return F.element_at(F.call_function("transform", bound, F.expr(f"{row} -> {sql}")), 1)


def let(value: str, body: Callable[[str], str], name: str | None = None) -> str:
    """Bind `value` once and use it many times in `body`.

    Catalyst may inline a projected column into a lambda that runs per element;
    a lambda variable is evaluated exactly once whatever the optimizer does.
    """
    v = name or fresh()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def each(items: str, body: Callable[[str], str]) -> str:
    v = fresh("x")
    return f"transform({items}, {v} -> {body(v)})"


def each_at(items: str, body: Callable[[str, str], str]) -> str:
    v, i = fresh("x"), fresh("i")
    return f"transform({items}, ({v}, {i}) -> {body(v, i)})"


def keep(items: str, test: Callable[[str], str]) -> str:
    v = fresh("x")
    return f"filter({items}, {v} -> {test(v)})"


def some(items: str, test: Callable[[str], str]) -> str:
    v = fresh("x")
    return f"exists({items}, {v} -> {test(v)})"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def empty(kind: str) -> str:
    return f"CAST(array() AS array<{kind}>)"


def emit_if(cond: str, item: str, kind: str) -> str:
    """One-element array when `cond` holds, else an empty one."""
    return f"CASE WHEN {cond} THEN array(CAST({item} AS {kind})) ELSE {empty(kind)} END"


def fold_emit(
    items: str, state: str, step: Callable[[str, str], tuple[str, str] | str], state_type: str, out_type: str
) -> str:
    """Left fold that also emits elements.

    `step(state, item)` gives the SQL of the next state and of an array that is
    appended to the output, as a pair or as one `struct(state, emit)`. The result
    is `struct(state, out)`.
    """
    acc, cur, block, x, done = fresh("acc"), fresh("cur"), fresh("b"), fresh("x"), fresh("done")
    o = fresh("o")

    def outer(v: str) -> str:
        result = step(f"{cur}.state", x)

        def advanced(next_state: str, emit: str) -> str:
            return (
                f"named_struct('state', CAST({next_state} AS {state_type}), "
                f"'cur', concat({cur}.cur, CAST({emit} AS array<{out_type}>)))"
            )

        # a lambda's result is copied whole, so a block is not bound by `let`: it waits in `at`, and the block after it,
        # or the end, appends what it emitted
        advance = advanced(*result) if isinstance(result, tuple) else let(result, lambda s: advanced(f"{s}.state", f"{s}.emit"))
        inner = (
            f"aggregate(slice({v}, {block} * {BLOCK} + 1, {BLOCK}), "
            f"named_struct('state', CAST({acc}.at.state AS {state_type}), 'cur', {empty(out_type)}), "
            f"({cur}, {x}) -> {advance})"
        )
        folded = (
            f"aggregate(sequence(0, greatest(CAST(ceil(size({v}) / {BLOCK}) AS int) - 1, 0)), "
            f"named_struct('at', named_struct('state', CAST({state} AS {state_type}), 'cur', {empty(out_type)}), 'done', CAST(array() AS array<array<{out_type}>>)), "
            f"({acc}, {block}) -> named_struct('at', {inner}, 'done', concat({acc}.done, array({acc}.at.cur))))"
        )
        return let(folded, lambda d: f"named_struct('state', {d}.at.state, 'out', concat(flatten({d}.done), {d}.at.cur))", o)

    return let(items, outer, done)
