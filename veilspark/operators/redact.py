"""Tags, redaction and the reported form of findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rowsql import column, each_at, let, lit
from veilspark.functions.text import segment_slice, segments
from veilspark.schema import PATTERN, SECRET


def tag_sql(source: str, entity_type: str) -> str:
    return (
        f"CASE {source} WHEN {lit(SECRET)} THEN concat('[REDACTED:', {entity_type}, ']') "
        f"WHEN {lit(PATTERN)} THEN concat('[', {entity_type}, ']') ELSE concat('[', upper({entity_type}), ']') END"
    )


def tag(source: Column, entity_type: Column) -> Column:
    """`[REDACTED:TYPE]` for secrets, `[TYPE]` for the pattern layer, upper case otherwise."""
    return column(tag_sql, source=source, entity_type=entity_type)


def redact_sql(text: str, merged: str) -> str:
    """SQL of `redact`."""

    def splice(segs: str) -> str:
        def piece(f: str, i: str) -> str:
            gap = segment_slice(segs, f"coalesce(get({merged}, {i} - 1).end, 0)", f"{f}.start")
            return f"concat({gap}, {tag_sql(f'{f}.source', f'{f}.entity_type')})"

        rest = segment_slice(segs, f"element_at({merged}, -1).end", f"length({text})")
        return f"concat(array_join({each_at(merged, piece)}, ''), {rest})"

    return f"CASE WHEN size({merged}) > 0 THEN {let(segments(text), splice)} ELSE {text} END"


def redact(text: Column, merged: Column) -> Column:
    """Put a tag in place of every merged (disjoint, sorted) finding."""
    return column(redact_sql, text=text, merged=merged)


def project_findings(merged: Column, debug: bool = False, offsets: bool = False) -> Column:
    """Reported findings: no matched text unless `debug`, no offsets unless asked."""

    def reported(f: Column) -> Column:
        fields = [f["source"].alias("source"), f["entity_type"].alias("rule")]
        if debug:
            fields.append(f["text"].alias("text"))
        fields += [
            f["score"].alias("score"),
            F.coalesce(f["description"], f["entity_type"]).alias("description"),
            f["reason"].alias("reason"),
        ]
        if offsets:
            fields += [f["start"].alias("start"), f["end"].alias("end")]
        return F.struct(*fields)

    return F.transform(merged, reported)


def layer_count(findings: Column) -> Column:
    """Raw count of one layer; NULL when the layer did not run."""
    return F.when(findings.isNotNull(), F.size(findings))
