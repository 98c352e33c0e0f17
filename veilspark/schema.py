"""Types and fixed names shared by every operator."""

from __future__ import annotations

# Layers, in the order their findings are concatenated.
SECRET, PATTERN, LEXICON, CROSSREF = "secret", "pattern", "lexicon", "crossref"
LAYERS = (SECRET, PATTERN, LEXICON, CROSSREF)

# Priority of a layer when two findings tie on score.
PRIORITY = {SECRET: 3, PATTERN: 2, LEXICON: 1, CROSSREF: 1}

DEPTHS = ("quick", "standard", "deep")

SPAN = "struct<start:int,end:int,text:string>"
SPANS = f"array<{SPAN}>"

# `start`/`end` are half-open code point offsets into the scanned text.
FINDING_FIELDS = ("start", "end", "score", "source", "entity_type", "text", "description", "reason")
FINDING = (
    "struct<start:int,end:int,score:double,source:string,entity_type:string,"
    "text:string,description:string,reason:string>"
)
FINDINGS = f"array<{FINDING}>"
NO_FINDINGS = f"CAST(array() AS {FINDINGS})"

# Sort key first, so that the natural order of the struct is the merge order.
ORDERED = (
    "struct<start:int,neg_score:double,neg_prio:int,ord:int,end:int,source:string,"
    "entity_type:string,text:string,description:string,reason:string>"
)


def finding(start, end, score, source, entity_type, text, description="NULL", reason="NULL") -> str:
    """SQL of one finding struct."""
    values = (start, end, score, source, entity_type, text, description, reason)
    types = ("int", "int", "double", "string", "string", "string", "string", "string")
    fields = ", ".join(
        f"'{name}', CAST({value} AS {kind})" for name, value, kind in zip(FINDING_FIELDS, values, types, strict=True)
    )
    return f"named_struct({fields})"
