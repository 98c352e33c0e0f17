"""Lexicon layer: lookup lists, person names with particles, dates, ages, numbers.

A lookup list comes in one of two forms with the same result. A `Lexicon` is a list in
the program, compiled into the expressions of the scan. A table `(term, tag)` of any size
stays a table: `with_listed` adds to each text the places of its listed terms, by joins
that ship hits only.

The rules here are approximations built from public descriptions of what a Dutch
de-identifier reports; they claim no parity with any engine.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.rowsql import column, each, empty, fold_emit, keep, let, lit, struct
from veilspark.functions.spans import spans_of
from veilspark.functions.text import W_END, W_START, WORD, segment_slice, segments
from veilspark.operators.places import bitmap, places, shapes_of, with_shape
from veilspark.operators.rules import Rule, detect_sql, sort_by_start
from veilspark.operators.structured import BSN, EMAIL, NL_PHONE, java_form
from veilspark.schema import LEXICON, NO_FINDINGS, PATTERN, finding

LEXICON_SCORE = 0.75
ENTITY_SCORE = 0.85

PERSON_TAG, PLACE_TAG, ORG_TAG, HOSPITAL_TAG = "persoon", "locatie", "organisatie", "ziekenhuis"
# Entity of the pattern layer for each lexicon tag.
ENTITY_OF_TAG = {
    PERSON_TAG: "PERSON",
    PLACE_TAG: "LOCATION",
    ORG_TAG: "ORGANIZATION",
    HOSPITAL_TAG: "ORGANIZATION",
}

MONTHS = (
    "januari", "februari", "maart", "april", "mei", "juni", "juli",
    "augustus", "september", "oktober", "november", "december",
)


@dataclass(frozen=True)
class Lexicon:
    """A lookup list, `(term, tag)`, kept in the program; a large one belongs in a table."""

    terms: tuple[tuple[str, str], ...] = field(default=())

    @classmethod
    def of(cls, terms: Iterable[tuple[str, str]]) -> Lexicon:
        return cls(tuple(sorted(set(terms))))

    def with_tag(self, tag: str) -> tuple[str, ...]:
        return tuple(t for t, g in self.terms if g == tag)

    def tags(self) -> dict[str, str]:
        """Tag of each term; of several tags the first by name."""
        out: dict[str, str] = {}
        for term, tag in self.terms:
            out.setdefault(term, tag)
        return out


_SPECIAL = frozenset("\\.[]{}()*+-?^$|&#~<>=!:,/\"'` \t\n")


def _literal(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL and not ch.isspace() else ch


def _alternation(terms: Iterable[str]) -> str:
    """Regex for a set of terms with shared prefixes factored out, so that a
    position in the text is tested once per prefix and not once per term."""
    heads: dict[str, set[str]] = {}
    for term in terms:
        heads.setdefault(term[:1], set()).add(term[1:])
    ends = heads.pop("", None) is not None
    branches = []
    for ch in sorted(heads):
        tails = heads[ch]
        prefix = _literal(ch)
        while len(tails) == 1 and (only := next(iter(tails))):
            prefix, tails = prefix + _literal(only[0]), {only[1:]}
        branches.append(prefix + (_alternation(tails) if tails != {""} else ""))
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + ("?" if ends else "")


def lexicon_pattern(terms: Iterable[str]) -> str:
    """Longest listed term between word boundaries."""
    return W_START + _alternation(t for t in terms if t) + W_END


def lexicon_findings(text: str, lexicon: Lexicon, layer: str = LEXICON) -> str:
    """SQL: listed terms in a text, with the term's tag (lexicon layer) or the
    entity of its tag (pattern layer)."""
    tags = lexicon.tags()
    labels = tags if layer == LEXICON else {t: ENTITY_OF_TAG[g] for t, g in tags.items() if g in ENTITY_OF_TAG}
    if not labels:
        return NO_FINDINGS
    score = LEXICON_SCORE if layer == LEXICON else ENTITY_SCORE
    label_of = "map(" + ", ".join(f"{lit(t)}, {lit(g)}" for t, g in labels.items()) + ")"
    return each(
        spans_of(text, lit(lexicon_pattern(labels))),
        lambda s: finding(f"{s}.start", f"{s}.end", f"{score}D", lit(layer), f"{label_of}[{s}.text]", f"{s}.text"),
    )


# Particles inside a name; prepositions such as `in` or `uit` join a name to a
# place and are left out.
NAME_PARTICLES = ("van", "von", "de", "der", "den", "des", "het", "'t", "ten", "ter", "te", "la", "le", "du", "el", "al", "da", "di")
_PARTICLE = "(?:" + "|".join(NAME_PARTICLES) + ")"
_CAPITAL = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*"
# Possessive, so that a tail of any length needs no recursion; each step ends where a word ends.
_NAME_TAIL = rf"(?:(?: {_PARTICLE}(?= ))*+ {_CAPITAL}{W_END})*+"


def person_findings(text: str, lexicon: Lexicon, layer: str = LEXICON) -> str:
    """SQL: runs of capitalised words and particles that start with a listed name."""
    names = lexicon.with_tag(PERSON_TAG)
    if not names:
        return NO_FINDINGS
    label, score = (PERSON_TAG, LEXICON_SCORE) if layer == LEXICON else (ENTITY_OF_TAG[PERSON_TAG], ENTITY_SCORE)
    pattern = W_START + _alternation(names) + W_END + _NAME_TAIL + W_END
    return each(
        spans_of(text, lit(pattern)),
        lambda s: finding(f"{s}.start", f"{s}.end", f"{score}D", lit(layer), lit(label), f"{s}.text"),
    )


_DAY, _MONTH, _YEAR = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:(?:19|20)[0-9]{2}|[0-9]{2})"
DATE_NUMERIC = Rule(
    "datum", W_START + rf"{_DAY}(?:-{_MONTH}-|/{_MONTH}/|\.{_MONTH}\.){_YEAR}" + W_END,
    LEXICON_SCORE, digits=True, hint=r"[0-9][-/.][0-9]{1,2}[-/.][0-9]{2}",
)
DATE_WORDS = Rule(
    "datum", W_START + rf"{_DAY} (?i:{'|'.join(MONTHS)})(?: (?:19|20)[0-9]{{2}})?" + W_END,
    LEXICON_SCORE, digits=True, hint=rf"[0-9] (?i:{'|'.join(MONTHS)})",
)
AGE = Rule(
    "leeftijd", W_START + r"(?:1[01][0-9]|[1-9]?[0-9])(?=(?: |-)?(?i:jaar|jarige)(?![\p{L}\p{N}_]))",
    LEXICON_SCORE, digits=True, hint=r"(?i)[0-9][ -]?(?:jaar|jarige)",
)
PATIENT = Rule(
    "patientnummer",
    r"(?<=(?iu:patient|patiënt|patientnr|patiëntnr|patientnummer|patiëntnummer)[.:]? {0,2}[.:]? {0,2})[0-9]{5,10}" + W_END,
    LEXICON_SCORE, digits=True, hint=r"(?iu)pati[eë]nt",
)
LEXICON_RULES = (
    DATE_NUMERIC,
    DATE_WORDS,
    AGE,
    PATIENT,
    *[
        replace(java_form(r), entity="telefoonnummer", score=LEXICON_SCORE, context=())
        for r in NL_PHONE
    ],
    replace(EMAIL, entity="emailadres", score=LEXICON_SCORE),
    replace(java_form(BSN), entity="bsn", score=LEXICON_SCORE, checked_score=None, context=()),
)


def lexicon_sql(text: str, lexicon: Lexicon | str | None, rules: Iterable[Rule]) -> str:
    parts = [detect_sql(text, rules, LEXICON, "0.0D")]
    if lexicon is not None:
        parts += _names_and_places(text, lexicon, LEXICON)
    if len(parts) == 1:
        return parts[0]
    return let(
        f"concat({', '.join(parts)})", lambda fs: f"CASE WHEN size({fs}) > 1 THEN {sort_by_start(fs)} ELSE {fs} END"
    )


def detect_lexicon(text: Column, lexicon: Lexicon | Column | None = None, rules: Iterable[Rule] = LEXICON_RULES) -> Column:
    """The lexicon layer of one text, all at one fixed score, sorted by start; lexicon: a list, or the column of `with_listed`."""
    rules = list(rules)
    return with_lexicon(lambda t, lexicon_: lexicon_sql(t, lexicon_, rules), text, lexicon)


def with_lexicon(body, text: Column, lexicon: Lexicon | Column | None) -> Column:
    """Column of `body(text, lexicon)`, where a lexicon that is a column becomes the SQL of its array."""
    if isinstance(lexicon, Column):
        return column(lambda t, found: body(t, found), t=text, found=lexicon)
    return column(lambda t: body(t, lexicon), t=text)


def entities_sql(text: str, lexicon: Lexicon | str | None, entities: Iterable[str] = ()) -> str:
    """SQL: PERSON, LOCATION and ORGANIZATION of the pattern layer, from the lexicon."""
    if lexicon is None:
        return NO_FINDINGS
    wanted = ", ".join(lit(e) for e in entities)
    found = f"concat({', '.join(_names_and_places(text, lexicon, PATTERN))})"
    return keep(found, lambda f: f"{f}.entity_type IN ({wanted})") if wanted else found


def detect_entities(text: Column, lexicon: Lexicon | Column | None, entities: Iterable[str] = ()) -> Column:
    entities = tuple(entities)
    return with_lexicon(lambda t, lexicon_: entities_sql(t, lexicon_, entities), text, lexicon)


def _names_and_places(text: str, lexicon: Lexicon | str, layer: str) -> list[str]:
    if isinstance(lexicon, str):
        return [listed_persons(text, lexicon, layer), listed_others(lexicon, layer)]
    others = Lexicon(tuple(t for t in lexicon.terms if t[1] != PERSON_TAG))
    return [person_findings(text, lexicon, layer), lexicon_findings(text, others, layer)]


# A listed term in a text: `tag` is its first one by name, `other` the first that is not a person's.
LISTED = "struct<start:int,neg_end:int,tag:string,text:string,other:string,person:boolean>"


def term_table(lexicon: DataFrame) -> DataFrame:
    """(term, tag, other, person, shape, first) of a table (term, tag); each term once."""
    own = F.col("tag") == PERSON_TAG
    terms = lexicon.filter(F.length("term") > 0).groupBy("term").agg(
        F.min("tag").alias("tag"), F.min(F.when(~own, F.col("tag"))).alias("other"), F.coalesce(F.max(own), F.lit(False)).alias("person")
    )
    return with_shape(terms)


def with_listed(df: DataFrame, lexicon: DataFrame, text: str = "text", name: str = "_listed") -> DataFrame:
    """Add the places of all listed terms in a text, array<LISTED>, sorted; they may overlap.

    Texts meet the list by their hash: equal texts are looked up once, and what is
    shuffled of a text are its hits. Null texts have none.
    """
    terms = term_table(lexicon)
    key, body = f"{name}_key", F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn(key, F.unhex(F.md5(body)))
    shaped = keyed.select(key, body.alias("body"), shapes_of(terms).alias("shapes"))
    found = shaped.select(key, F.explode(places(F.col("body"), F.col("shapes"), bitmap(terms, lambda v: v))).alias("p")).distinct()
    hit = F.struct(
        F.col("p.start").alias("start"), (-F.col("p.end")).alias("neg_end"), F.col("tag"), F.col("term").alias("text"), F.col("other"), F.col("person")
    ).cast(LISTED)
    hits = found.join(terms, F.col("p.text") == F.col("term")).groupBy(key).agg(F.array_sort(F.collect_list(hit)).alias(name))
    joined = keyed.join(hits.withColumnRenamed(key, f"{key}_"), F.col(key) == F.col(f"{key}_"), "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.expr(empty(LISTED)))).select(*df.columns, name)


def listed_others(listed: str, layer: str) -> str:
    """SQL of `lexicon_findings` for the array of `with_listed`."""
    label = "{h}.other" if layer == LEXICON else "map(" + ", ".join(f"{lit(t)}, {lit(e)}" for t, e in ENTITY_OF_TAG.items()) + ")[{h}.other]"
    score = LEXICON_SCORE if layer == LEXICON else ENTITY_SCORE
    wanted = keep(listed, lambda h: f"{label.format(h=h)} IS NOT NULL")
    return each(
        leftmost_longest(wanted),
        lambda h: finding(f"{h}.start", f"-{h}.neg_end", f"{score}D", lit(layer), label.format(h=h), f"{h}.text"),
    )


# All that may follow a name: a maximal run of tail steps, wherever it begins.
_TAILS = rf"(?:(?: {_PARTICLE}(?= ))*+ {_CAPITAL}{W_END})++"
_NAME = "struct<start:int,neg_end:int,stop:int>"


def listed_persons(text: str, listed: str, layer: str) -> str:
    """SQL of `person_findings` for the array of `with_listed`.

    The tails of a text are searched once. A name that ends at a blank inside a tail, or
    where one begins, goes on to the tail's end; names and tails meet in one sorted walk.
    """
    label, score = (PERSON_TAG, LEXICON_SCORE) if layer == LEXICON else (ENTITY_OF_TAG[PERSON_TAG], ENTITY_SCORE)

    def stops(names: str, segs: str) -> str:
        at = "struct<at:int,kind:int,start:int,end:int>"
        tails = each(spans_of(text, lit(_TAILS)), lambda s: f"CAST({struct(at=f'{s}.start', kind='0', start=f'{s}.start', end=f'{s}.end')} AS {at})")
        ends = each(names, lambda h: f"CAST({struct(at=f'-{h}.neg_end', kind='1', start=f'{h}.start', end=f'-{h}.neg_end')} AS {at})")

        def step(tail: str, e: str) -> tuple[str, str]:
            inside = f"{tail} > {e}.end AND {segment_slice(segs, f'{e}.end', f'{e}.end + 1')} = ' '"
            made = struct(start=f"{e}.start", neg_end=f"-{e}.end", stop=f"CASE WHEN {inside} THEN {tail} ELSE {e}.end END")
            return f"CASE WHEN {e}.kind = 0 THEN {e}.end ELSE {tail} END", f"CASE WHEN {e}.kind = 1 THEN array(CAST({made} AS {_NAME})) ELSE {empty(_NAME)} END"

        return f"array_sort({fold_emit(f'array_sort(concat({tails}, {ends}))', '0', step, 'int', _NAME)}.out)"

    def claim(last: str, n: str) -> tuple[str, str]:
        free = f"{n}.start >= {last}"
        return f"CASE WHEN {free} THEN {n}.stop ELSE {last} END", f"CASE WHEN {free} THEN array({n}) ELSE {empty(_NAME)} END"

    def persons(names: str) -> str:
        def made(segs: str) -> str:
            disjoint = f"{fold_emit(stops(names, segs), '0', claim, 'int', _NAME)}.out"
            return each(
                disjoint,
                lambda n: finding(f"{n}.start", f"{n}.stop", f"{score}D", lit(layer), lit(label), segment_slice(segs, f"{n}.start", f"{n}.stop")),
            )

        return f"CASE WHEN size({names}) > 0 THEN {let(segments(text), made)} ELSE {NO_FINDINGS} END"

    return let(keep(listed, lambda h: f"{h}.person"), persons)


def lexicon_join(docs: DataFrame, lexicon: DataFrame, max_words: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Listed terms as rows (id, start, end, tag, text), leftmost first, longest at one start, disjoint; with `max_words`,
    terms of so many words. Terms may begin and end in any character and have any number of words."""
    if max_words is not None:
        lexicon = lexicon.filter(F.regexp_count("term", F.lit(f"[{WORD}]+")) <= max_words)
    found = with_listed(docs.select(id, text), lexicon, text).select(id, F.explode(column(leftmost_longest, hits=F.col("_listed"))).alias("h"))
    return found.select(
        id, F.col("h.start").alias("start"), (-F.col("h.neg_end")).alias("end"), F.col("h.tag").alias("tag"), F.col("h.text").alias("text")
    )


def leftmost_longest(hits: str) -> str:
    """SQL: disjoint hits out of hits sorted by start, longest first."""

    def step(last: str, h: str) -> tuple[str, str]:
        free = f"{h}.start >= {last}"
        return f"CASE WHEN {free} THEN -{h}.neg_end ELSE {last} END", f"CASE WHEN {free} THEN array({h}) ELSE {empty(LISTED)} END"

    return fold_emit(hits, "0", step, "int", LISTED) + ".out"
