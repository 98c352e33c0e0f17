"""Cross-reference inside one document: found values are searched again in its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.rowsql import column, each, each_at, empty, fold_emit, keep, let, lit, some, struct
from veilspark.functions.spans import run_blocks, run_start, runs_of, spans_of
from veilspark.functions.text import W_BOUND, W_END, W_START, WORD, fold_case, segment_slice, segments
from veilspark.operators.secrets import quoted_sql
from veilspark.schema import CROSSREF, FINDING, NO_FINDINGS, SPAN, finding

# Words that are never searched for.
SKIP_WORDS = (
    "de", "het", "een", "van", "in", "op", "te", "en", "is", "dat", "die", "voor",
    "met", "zijn", "naar", "aan", "bij", "uit", "als", "maar", "nog", "wel", "niet",
    "ook", "dan", "kan", "moet", "zou", "zal", "heeft", "wordt", "werd", "geen",
    "meer", "veel", "goed", "naam", "naam:", "email", "telefoon", "adres", "straat",
    "true", "false", "null", "none", "yes", "no", "the", "and", "for", "with",
)
# Name particles that are never searched for on their own.
PARTICLES = (
    "van", "de", "den", "der", "het", "ten", "ter", "te", "in", "op",
    "aan", "bij", "tot", "uit", "von", "la", "le", "du", "des",
)
# Shortest value searched, score of an unscored origin, of a name.
MIN_VALUE, DEFAULT_SCORE, NAME_SCORE = 3, 0.7, 0.5
EMAIL_TYPES = ("EMAIL_ADDRESS", "email")
VALUE_REASON, NAME_REASON = "value-propagation", "email-extraction"

def common_word(value: str) -> str:
    words = ", ".join(lit(w) for w in dict.fromkeys(SKIP_WORDS + PARTICLES))
    return f"lower({value}) IN ({words})"


def eligible_sql(value: str) -> str:
    return f"(length({value}) >= {MIN_VALUE} AND NOT {common_word(value)})"


def eligible(value: Column) -> Column:
    """Long enough and no common word or particle."""
    return column(eligible_sql, value=value)


def email_names_sql(email: str) -> str:
    def names(local: str) -> str:
        strip = lit(r"(?U)^\s+|\s+\z")
        alphabetic = lit(r"^\p{L}+\z")
        parts = each(f"split({local}, {lit('[._-]')})", lambda p: f"regexp_replace({p}, {strip}, '')")
        kept = keep(parts, lambda p: f"length({p}) >= 2 AND {p} RLIKE {alphabetic} AND NOT {common_word(p)}")
        return f"CASE WHEN length({local}) >= 3 THEN {kept} ELSE {empty('string')} END"

    return let(f"CASE WHEN contains({email}, '@') THEN substring_index({email}, '@', 1) ELSE '' END", names)


def email_names(email: Column) -> Column:
    """Likely person names in the local part of an address."""
    return column(email_names_sql, email=email)


def occurrence_pattern(value: str) -> str:
    """SQL: case-insensitive literal match between word boundaries."""
    # next to a word character the boundary is a one-sided test, which is cheaper
    starts, ends = lit(f"^[{WORD}]"), lit(rf"[{WORD}]\z")
    head = f"CASE WHEN {value} RLIKE {starts} THEN {lit(W_START)} ELSE {lit(W_BOUND)} END"
    tail = f"CASE WHEN {value} RLIKE {ends} THEN {lit(W_END)} ELSE {lit(W_BOUND)} END"
    return f"concat('(?iu)', {head}, {quoted_sql(value)}, {tail})"


def occurrences_sql(text: str, value: str) -> str:
    found = let(occurrence_pattern(value), lambda p: spans_of(text, p))
    return f"CASE WHEN length({value}) >= {MIN_VALUE} THEN {found} ELSE {empty(SPAN)} END"


def occurrences(text: Column, value: Column) -> Column:
    """Where a value stands in the text; none for a value that is too short."""
    return column(occurrences_sql, text=text, value=value)


def uncovered_sql(found: str, covered: str) -> str:
    return keep(
        found,
        lambda o: "NOT "
        + some(covered, lambda c: f"{o}.start < {c}.end AND {c}.start < {o}.end AND {c}.end > {c}.start"),
    )


def uncovered(found: Column, covered: Column) -> Column:
    """Matches of which no position is covered yet."""
    return column(uncovered_sql, found=found, covered=covered)


_SEED = "struct<pass:int,ord:int,value:string,entity_type:string,score:double,reason:string>"


def seeds_sql(findings: str) -> str:
    """SQL: values to search for, in claim order: the found values first, then the
    names taken from found addresses."""

    def seed(number: int, order: str, value: str, entity: str, score: str, reason: str) -> str:
        made = struct(**{
            "pass": str(number), "ord": order, "value": value, "entity_type": entity, "score": score, "reason": lit(reason)
        })
        return f"CAST({made} AS {_SEED})"

    values = keep(
        each_at(
            findings,
            lambda f, i: seed(1, i, f"{f}.text", f"{f}.entity_type", f"coalesce({f}.score, {DEFAULT_SCORE}D)", VALUE_REASON),
        ),
        lambda s: eligible_sql(f"{s}.value"),
    )
    types = ", ".join(lit(t) for t in EMAIL_TYPES)
    addresses = keep(findings, lambda f: f"{f}.entity_type IN ({types})")
    names = keep(
        f"flatten({each(addresses, lambda f: email_names_sql(f'{f}.text'))})", lambda n: f"length({n}) >= {MIN_VALUE}"
    )
    named = each_at(names, lambda n, i: seed(2, i, n, "'PERSON'", f"{NAME_SCORE}D", NAME_REASON))
    return _first_claims(f"concat({values}, {named})")


def caseless(value: str) -> str:
    """SQL: comparison key: lower case, unless that changes the number of characters."""
    return f"CASE WHEN length(lower({value})) = length({value}) THEN lower({value}) ELSE {value} END"


def _first_claims(seeds: str) -> str:
    """One seed per value (compared without case), the earliest, in claim order:
    the first one claims every match, so the others would find nothing."""

    def step(prev: str, x: str) -> tuple[str, str]:
        return f"{x}.key", f"CASE WHEN {prev} IS NULL OR {prev} <> {x}.key THEN array({x}.s) ELSE {empty(_SEED)} END"

    keyed = each(seeds, lambda s: struct(key=caseless(f"{s}.value"), s=s))
    return f"array_sort({fold_emit(f'array_sort({keyed})', 'NULL', step, 'string', _SEED)}.out)"


_PAIR = "struct<start:int,end:int>"


def uncovered_text(text: str, findings: str) -> str:
    """SQL: what no finding covers, the gaps on lines of their own.

    A place that can still be claimed lies whole in one gap, so a value that does
    not stand here needs no pattern search.
    """

    def extents(length: str) -> str:
        def clipped(f: str) -> str:
            return struct(start=f"greatest(0, least({f}.start, {length}))", end=f"greatest(0, least({f}.end, {length}))")

        return f"array_sort({keep(each(findings, clipped), lambda c: f'{c}.end > {c}.start')})"

    def step(upto: str, c: str) -> tuple[str, str]:
        return f"greatest({upto}, {c}.end)", f"array({struct(start=upto, end=f'{c}.start')})"

    def joined(r: str, segs: str) -> str:
        whole = f"concat({r}.out, array({struct(start=f'{r}.state', end=f'length({text})')}))"
        return f"array_join({each(whole, lambda g: segment_slice(segs, f'{g}.start', f'{g}.end'))}, '\\n')"

    gaps = let(f"length({text})", lambda n: fold_emit(extents(n), "0", step, "int", _PAIR))
    return let(gaps, lambda r: let(segments(text), lambda segs: joined(r, segs)))


#: Up to this many values that stand in the uncovered text are searched one after the other; more in one walk. Up to this
#: many characters to compare (values x text), values that do not stand there are left out first. Results are the same.
ONE_BY_ONE, COMPARED = 4, 1 << 24


def present_sql(text: str, findings: str) -> str:
    """SQL: the seeds of a document, without those that stand nowhere in its uncovered text if that is cheap to tell."""

    def standing(seeds: str) -> str:
        kept = let(fold_case(uncovered_text(text, findings)), lambda rest: keep(seeds, lambda s: f"contains({rest}, {fold_case(f'{s}.value')})"))
        return f"CASE WHEN size({seeds}) = 0 OR size({seeds}) * CAST(length({text}) AS bigint) > {COMPARED}L THEN {seeds} ELSE {kept} END"

    return f"CASE WHEN size({findings}) > 0 THEN {let(seeds_sql(findings), standing)} ELSE {empty(_SEED)} END"


def _claimed(o: str, s: str) -> str:
    return finding(f"{o}.start", f"{o}.end", f"{s}.score", lit(CROSSREF), f"{s}.entity_type", f"{o}.text", "NULL", f"{s}.reason")


def _one_by_one(text: str, findings: str, seeds: str) -> str:
    """SQL: each value's matches, searched by pattern, that nothing covers so far."""

    def extents(items: str) -> str:
        return each(items, lambda o: struct(start=f"{o}.start", end=f"{o}.end"))

    def step(covered: str, s: str) -> str:
        def claim(claimed: str) -> str:
            return struct(state=f"concat({covered}, {extents(claimed)})", emit=each(claimed, lambda o: _claimed(o, s)))

        return let(uncovered_sql(occurrences_sql(text, f"{s}.value"), covered), claim)

    return fold_emit(seeds, extents(findings), step, f"array<{_PAIR}>", FINDING) + ".out"


_VALUE = "struct<n_runs:int,starts_word:boolean,folded:string,seed:int>"
_MEET = f"struct<key:string,kind:int,i:int,v:{_VALUE}>"
_PLACE = "struct<start:int,end:int,seed:int,text:string>"
_BY_SEED = "struct<seed:int,start:int,end:int,text:string>"
_CLAIM = f"struct<seed:int,start:int,f:{FINDING}>"


def places_sql(text: str, seeds: str) -> str:
    """SQL: where the values of many seeds stand.

    Values and the runs of the text meet in one sorted walk, by a value's first run; a
    slice is compared only where that run is equal.
    """

    def met(runs: str, blocks: str, first_is_word: str) -> str:
        def value(s: str, i: str) -> str:
            made = struct(n_runs=f"size({runs_of(f'{s}.value')})", starts_word=f"{s}.value RLIKE {lit(f'^[{WORD}]')}", folded=fold_case(f"{s}.value"), seed=i)
            return f"CAST({struct(key=fold_case(f'get({runs_of(f"{s}.value")}, 0)'), kind='0', i='0', v=made)} AS {_MEET})"

        run = lambda r, i: f"CAST({struct(key=fold_case(r), kind='1', i=i, v='NULL')} AS {_MEET})"
        both = f"array_sort(concat({each_at(seeds, value)}, {each_at(runs, run)}))"
        state = f"struct<key:string,values:array<{_VALUE}>>"

        def at_run(i: str, values: str) -> str:
            is_word = f"(({i} % 2 = 0) = {first_is_word})"

            def place(v: str) -> str:
                ends_word = f"({v}.starts_word = ({v}.n_runs % 2 = 1))"
                fits = f"{v}.starts_word = {is_word} AND {i} + {v}.n_runs <= size({runs}) AND ({v}.starts_word OR {i} > 0) AND ({ends_word} OR {i} + {v}.n_runs < size({runs}))"

                def compared(t: str) -> str:
                    same = f"{fold_case(t)} = {v}.folded AND {t} RLIKE concat('(?iu)^', {quoted_sql(f'get({seeds}, {v}.seed).value')}, {lit(chr(92) + 'z')})"
                    made = let(run_start(runs, blocks, i), lambda at: struct(start=at, end=f"{at} + length({t})", seed=f"{v}.seed", text=t))
                    return f"CASE WHEN {same} THEN CAST({made} AS {_PLACE}) END"

                return f"CASE WHEN {fits} THEN {let(f"array_join(slice({runs}, {i} + 1, {v}.n_runs), '')", compared)} END"

            return keep(each(values, place), lambda p: f"{p} IS NOT NULL")

        def step(st: str, m: str) -> tuple[str, str]:
            grown = f"CASE WHEN {st}.key = {m}.key THEN concat({st}.values, array({m}.v)) ELSE array({m}.v) END"
            after = f"CASE WHEN {m}.kind = 0 THEN {struct(key=f'{m}.key', values=grown)} ELSE {st} END"
            return after, f"CASE WHEN {m}.kind = 1 AND {st}.key = {m}.key THEN {at_run(f'{m}.i', f'{st}.values')} ELSE {empty(_PLACE)} END"

        return fold_emit(both, struct(key="NULL", values="array()"), step, state, _PLACE) + ".out"

    def walked(runs: str) -> str:
        first_is_word = f"get({runs}, 0) RLIKE {lit(f'^[{WORD}]')}"
        return let(run_blocks(runs), lambda blocks: let(first_is_word, lambda w: met(runs, blocks, w)))

    return let(runs_of(text), walked)


def settled_sql(findings: str, seeds: str, found: str) -> str:
    """SQL: the claims among places. They are cut into clusters of overlap, with what is covered, and settled cluster by
    cluster in seed order, so the cost does not grow with the product of places and claims."""

    def settled() -> str:
        cover = keep(each(findings, lambda f: f"CAST({struct(start=f'{f}.start', end=f'{f}.end', seed='-1', text='NULL')} AS {_PLACE})"), lambda c: f"{c}.end > {c}.start")
        members = f"array_sort(concat({cover}, {found}))"
        state = f"struct<upto:int,open:array<{_PLACE}>>"

        def cluster(st: str, p: str) -> tuple[str, str]:
            opens = f"{p}.start >= {st}.upto"
            after = struct(upto=f"greatest({st}.upto, {p}.end)", open=f"CASE WHEN {opens} THEN array({p}) ELSE concat({st}.open, array({p})) END")
            in_order = each(f"{st}.open", lambda o: f"CAST({struct(seed=f'{o}.seed', start=f'{o}.start', end=f'{o}.end', text=f'{o}.text')} AS {_BY_SEED})")
            closed = f"array(array_sort({in_order}))"
            return after, f"CASE WHEN {opens} AND size({st}.open) > 0 THEN {closed} ELSE {empty(f'array<{_BY_SEED}>')} END"

        sentinel = f"CAST({struct(start='2147483647', end='2147483647', seed='-1', text='NULL')} AS {_PLACE})"
        clusters = f"{fold_emit(f'concat({members}, array({sentinel}))', struct(upto='0', open='array()'), cluster, state, f'array<{_BY_SEED}>')}.out"
        claims = f"array_sort(flatten({each(clusters, claims_of)}))"
        return each(claims, lambda c: f"{c}.f")

    def claims_of(places: str) -> str:
        """Places of one cluster in seed order: of a value's own overlapping places the leftmost counts, then what is free is claimed."""
        state = f"struct<covered:array<{_PAIR}>,seed:int,upto:int>"

        def step(st: str, p: str) -> str:
            free = "NOT " + some(f"{st}.covered", lambda c: f"{p}.start < {c}.end AND {c}.start < {p}.end")

            def decided(f: str) -> str:
                grown = f"CASE WHEN {f} OR {p}.seed < 0 THEN concat({st}.covered, array({struct(start=f'{p}.start', end=f'{p}.end')})) ELSE {st}.covered END"
                after = struct(covered=grown, seed=f"{p}.seed", upto=f"{p}.end")
                return struct(state=f"CAST({after} AS {state})", emit=f"CASE WHEN {f} AND {p}.seed >= 0 THEN array({claim(p)}) ELSE {empty(_CLAIM)} END")

            repeats = f"{p}.seed >= 0 AND {st}.seed = {p}.seed AND {p}.start < {st}.upto"
            return f"CASE WHEN {repeats} THEN {struct(state=st, emit=empty(_CLAIM))} ELSE {let(free, decided)} END"

        def claim(p: str) -> str:
            return f"CAST({struct(seed=f'{p}.seed', start=f'{p}.start', f=let(f'get({seeds}, {p}.seed)', lambda s: _claimed(p, s)))} AS {_CLAIM})"

        return fold_emit(places, struct(covered="array()", seed="-1", upto="0"), step, state, _CLAIM) + ".out"

    return settled()


def propagate(text: Column, findings: Column) -> Column:
    """Additional findings of a document: each seed claims the matches of its value that no finding and no earlier seed
    covers. One expression, which searches each value by itself; `with_propagated` does with many values in one walk."""
    return column(lambda t, f: let(present_sql(t, f), lambda seeds: _one_by_one(t, f, seeds)), text=text, findings=findings)


def with_propagated(df: DataFrame, text: Column, findings: str, name: str) -> DataFrame:
    """Add the findings of `propagate` as a column; the cost grows with the length of a text, however many values it holds."""
    seeds, found = f"{name}_seeds", f"{name}_places"
    many = f"size({seeds}) > {ONE_BY_ONE}"
    out = df.withColumn(seeds, column(present_sql, t=text, f=F.col(findings)))
    out = out.withColumn(found, F.when(F.expr(many), column(places_sql, t=text, s=F.col(seeds))))

    def claims(t: str, f: str, s: str, p: str) -> str:
        few = f"WHEN {p} IS NULL THEN {_one_by_one(t, f, s)}"
        return f"CASE WHEN size({s}) = 0 THEN {NO_FINDINGS} {few} ELSE {settled_sql(f, s, p)} END"

    return out.withColumn(name, column(claims, t=text, f=F.col(findings), s=F.col(seeds), p=F.col(found))).drop(seeds, found)
