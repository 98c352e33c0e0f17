"""Detection rules and their compilation to one array expression per layer."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rowsql import (
    column, each, each_at, emit_if, fold_emit, keep, let, lit, some, struct,
)
from veilspark.functions.spans import matches_of, placed
from veilspark.functions.text import segments
from veilspark.operators.context import boosted, cue_lists, has_cue, last_words
from veilspark.schema import FINDING, NO_FINDINGS, PATTERN, finding


@dataclass(frozen=True)
class Rule:
    """A pattern rule.

    `literals` (any must occur), `digits` (some digit must occur) and `hint` (a
    short regex) are cheap tests on the text; rows that fail them never run the
    pattern. `check` is a SQL condition
    on `value`, the matched text; `checked_score` replaces the score of a match
    that passes it. `refine` is a SQL expression that gives a leading part of
    `value`, or NULL to drop the match. `context` words before a match raise its
    score.
    """

    entity: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    check: str | None = None
    checked_score: float | None = None
    refine: str | None = None
    literals: tuple[str, ...] = ()
    digits: bool = False
    hint: str | None = None
    name: str | None = None

    @property
    def base_score(self) -> float:
        return self.score if self.checked_score is None else self.checked_score


@dataclass
class Registry:
    """A growing list of rules; `register` is the extension point of the engine."""

    rules: list[Rule] = field(default_factory=list)

    def register(self, rule: Rule) -> Registry:
        self.rules.append(rule)
        return self

    def for_entities(self, entities: Iterable[str] | None) -> list[Rule]:
        """Only the wanted rules are compiled, so the rest costs nothing."""
        wanted = set(entities or ())
        return [r for r in self.rules if not wanted or r.entity in wanted]


def any_of(text: str, literals: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(v)})" for v in literals) + ")"


def guard(text: str, literals: tuple[str, ...], hint: str | None, *more: str) -> str:
    """SQL: the cheap tests of a rule, cheapest first. A literal search is about a
    tenth of the cost of a regex, and a failed test ends the row's work."""
    tests = [any_of(text, literals)] if literals else []
    tests += more
    if hint is not None:
        tests.append(f"{text} RLIKE {lit(hint)}")
    return " AND ".join(tests) or "true"


def _hits(text: str, rules: list[Rule]) -> str:
    """Per rule with matches: its number and its matched texts."""

    def parts(has_digit: str) -> str:
        made = [
            struct(
                rule=str(i),
                ms=f"CASE WHEN {guard(text, r.literals, r.hint, *([has_digit] if r.digits else []))} "
                f"THEN {matches_of(text, lit(r.pattern))} END",
            )
            for i, r in enumerate(rules)
        ]
        return keep(f"array({', '.join(made)})", lambda h: f"size({h}.ms) > 0")

    return let(f"{text} RLIKE '[0-9]'", parts)


def _infos(rules: list[Rule]) -> str:
    """Constant array of what the later steps need to know of each rule."""
    rows = []
    for rule in rules:
        single, phrases = cue_lists(rule.context)
        rows.append(
            struct(
                pattern=lit(rule.pattern), entity=lit(rule.entity), score=f"{rule.base_score}D", single=single, phrases=phrases
            )
        )
    return f"array({', '.join(rows)})"


def _by_rule(rules: list[Rule], attr: str, number: str, value: str, default: str) -> str:
    """CASE over the rules that have `attr`, a SQL text over `value`."""
    cases = [
        f"WHEN {i} THEN {let(value, lambda _, r=r: getattr(r, attr), 'value')}"
        for i, r in enumerate(rules)
        if getattr(r, attr) is not None
    ]
    return f"CASE {number} {' '.join(cases)} ELSE {default} END" if cases else default


def _located(text: str, rules: list[Rule], infos: str, hit: str) -> str:
    """Checked spans of one rule with the rule number."""
    found = placed(text, f"get({infos}, {hit}.rule).pattern", f"{hit}.ms")
    refined = each(
        found,
        lambda s: struct(
            rule=f"{hit}.rule", start=f"{s}.start", text=_by_rule(rules, "refine", f"{hit}.rule", f"{s}.text", f"{s}.text")
        ),
    )
    return keep(
        refined,
        lambda s: f"{s}.text IS NOT NULL AND {_by_rule(rules, 'check', f'{s}.rule', f'{s}.text', 'true')}",
    )


def _scored(rules: list[Rule], layer: str, infos: str, segs: str, span: str) -> str:
    info = f"get({infos}, {span}.rule)"

    def with_info(i: str) -> str:
        score = f"{i}.score"
        if any(r.context for r in rules):
            cue = has_cue(last_words(segs, f"{span}.start"), f"{i}.single", f"{i}.phrases")
            score = f"CASE WHEN size({i}.single) + size({i}.phrases) > 0 AND {cue} THEN {boosted(f'{i}.score')} ELSE {i}.score END"
        made = finding(
            f"{span}.start", f"{span}.start + length({span}.text)", f"round({score}, 2)", lit(layer), f"{i}.entity", f"{span}.text"
        )
        return struct(rule=f"{span}.rule", f=made)

    return let(info, with_info)


_KEYED = f"struct<start:int,neg_end:int,neg_score:double,rule:int,f:{FINDING}>"


def _drop_contained(found: str) -> str:
    """Same-entity duplicates: a finding inside another one of its entity goes if
    the other has the higher score, or the same score and starts first or is longer.

    In the order start, longer first, higher score first, a containing finding
    comes before what it contains, and of every rule only the last one seen can
    still contain the next; so the fold carries one candidate per rule.
    """

    def step(seen: str, x: str) -> tuple[str, str]:
        covered = some(
            seen,
            lambda y: f"{y}.f.entity_type = {x}.f.entity_type AND {y}.neg_end <= {x}.neg_end AND {y}.neg_score <= {x}.neg_score",
        )
        state = f"concat({keep(seen, lambda y: f'{y}.rule <> {x}.rule')}, array({x}))"
        return state, emit_if(f"NOT {covered}", x, _KEYED)

    keyed = each(
        found,
        lambda k: f"CAST({struct(start=f'{k}.f.start', neg_end=f'-{k}.f.end', neg_score=f'-{k}.f.score', rule=f'{k}.rule', f=f'{k}.f')} AS {_KEYED})",
    )
    return fold_emit(f"array_sort({keyed})", "array()", step, f"array<{_KEYED}>", _KEYED) + ".out"


def detect_sql(text: str, rules: Iterable[Rule], layer: str = PATTERN, threshold: str = "0.5D") -> str:
    """SQL of `detect`. A text without a match costs the cheap tests, and the
    patterns that pass them, and nothing else."""
    rules = list(rules)
    if not rules:
        return NO_FINDINGS

    def findings(hits: str) -> str:
        def all_rules(infos: str) -> str:
            located = f"flatten({each(hits, lambda h: _located(text, rules, infos, h))})"
            scored = let(segments(text), lambda segs: each(located, lambda s: _scored(rules, layer, infos, segs, s)))
            kept = keep(_drop_contained(scored), lambda k: f"{k}.f.score >= {threshold}")
            # within one start: higher score first, then longer first
            keys = each(
                kept,
                lambda k: struct(
                    start=f"{k}.start", neg_score=f"{k}.neg_score", neg_end=f"{k}.neg_end", rule=f"{k}.rule", f=f"{k}.f"
                ),
            )
            return each(f"array_sort({keys})", lambda k: f"{k}.f")

        return f"CASE WHEN size({hits}) > 0 THEN {let(_infos(rules), all_rules)} ELSE {NO_FINDINGS} END"

    return let(_hits(text, rules), findings)


def detect(text: Column, rules: Iterable[Rule], layer: str = PATTERN, threshold: Column | float = 0.5) -> Column:
    """All findings of a rule set: scored, deduplicated per entity, cut at the
    threshold, sorted by start."""
    rules = list(rules)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return column(lambda t, k: detect_sql(t, rules, layer, k), t=text, k=limit)


def sort_by_start(findings: str) -> str:
    """SQL: stable sort by start offset."""
    keyed = each_at(findings, lambda f, i: struct(start=f"{f}.start", ord=i, f=f))
    return each(f"array_sort({keyed})", lambda k: f"{k}.f")


def no_findings() -> Column:
    return F.expr(NO_FINDINGS)

