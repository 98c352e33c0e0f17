"""Order, merge and cover overlapping findings.

The array forms are row-local. The table form (`merge_findings_table`) gives the
same result for findings kept as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.rowsql import column, each, each_at, emit_if, fold_emit, let, lit, struct
from veilspark.schema import FINDING, FINDING_FIELDS, FINDINGS, NO_FINDINGS, ORDERED, PRIORITY, finding


def priority(source: str) -> str:
    """SQL: layer priority; an unknown layer has 0."""
    return f"CASE {source} " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in PRIORITY.items()) + " ELSE 0 END"


def combine(*layers: Column) -> Column:
    """Findings of all layers in layer order; a layer that did not run adds none."""
    return F.concat(*[F.coalesce(layer.cast(FINDINGS), F.expr(NO_FINDINGS)) for layer in layers])


def ordered_sql(findings: str) -> str:
    """SQL: start asc, score desc, priority desc, then input order."""

    def key(f: str, i: str) -> str:
        fields = struct(
            start=f"{f}.start", neg_score=f"-{f}.score", neg_prio=f"-({priority(f'{f}.source')})", ord=i, end=f"{f}.end",
            source=f"{f}.source", entity_type=f"{f}.entity_type", text=f"{f}.text", description=f"{f}.description",
            reason=f"{f}.reason",
        )
        return f"CAST({fields} AS {ORDERED})"

    return f"array_sort({each_at(findings, key)})"


def _plain(k: str) -> str:
    return finding(
        f"{k}.start", f"{k}.end", f"-{k}.neg_score", f"{k}.source", f"{k}.entity_type", f"{k}.text", f"{k}.description",
        f"{k}.reason",
    )


def _better(f: str, prev: str) -> str:
    return f"({f}.neg_score < {prev}.neg_score OR ({f}.neg_score = {prev}.neg_score AND {f}.neg_prio < {prev}.neg_prio))"


def _closing(overlap: str, last: str, f: str) -> tuple[str, str]:
    """Fold step that keeps one open finding: a finding that starts at or after its
    end closes it, any other one gives the state `overlap`."""
    opens = f"({last} IS NULL OR {f}.start >= {last}.end)"
    return f"CASE WHEN {opens} THEN {f} ELSE {overlap} END", emit_if(f"{opens} AND {last} IS NOT NULL", last, ORDERED)


def _closed(ordered: str, step) -> str:
    folded = fold_emit(ordered, "NULL", step, ORDERED, ORDERED)
    return let(folded, lambda r: f"concat({r}.out, array({r}.state))")


def merge_sql(findings: str) -> str:
    """SQL of `merge_findings`."""

    def step(last: str, f: str) -> tuple[str, str]:
        replaces = f"{f}.end > {last}.end AND {_better(f, last)}"
        return _closing(f"CASE WHEN {replaces} THEN {f} ELSE {last} END", last, f)

    return f"CASE WHEN size({findings}) > 1 THEN {each(_closed(ordered_sql(findings), step), _plain)} ELSE {findings} END"


def cover_sql(findings: str) -> str:
    """SQL of `cover_findings`."""

    def step(last: str, f: str) -> tuple[str, str]:
        def joined(best: str) -> str:
            return struct(
                start=f"{last}.start", neg_score=f"{best}.neg_score", neg_prio=f"{best}.neg_prio", ord=f"{best}.ord",
                end=f"greatest({last}.end, {f}.end)", source=f"{best}.source", entity_type=f"{best}.entity_type",
                text=f"{best}.text", description=f"{best}.description", reason=f"{best}.reason",
            )

        best = let(f"CASE WHEN {_better(f, last)} THEN {f} ELSE {last} END", joined)
        return _closing(best, last, f)

    return f"CASE WHEN size({findings}) > 1 THEN {each(_closed(ordered_sql(findings), step), _plain)} ELSE {findings} END"


def merge_findings(findings: Column) -> Column:
    """Disjoint findings out of overlapping ones, sorted by start.

    An overlapping finding replaces the kept one only if it ends later and has a
    higher score, or the same score and a higher priority.
    """
    return column(merge_sql, findings=findings.cast(FINDINGS))


def cover_findings(findings: Column) -> Column:
    """Opt-in: every overlapping cluster becomes one finding over its whole extent,
    so no detected character stays. Type, layer and text come from the best member."""
    return column(cover_sql, findings=findings.cast(FINDINGS))


def with_islands(df: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Number the clusters of overlapping spans within each key (`island`).

    A span opens a cluster when it starts at or after every earlier end. The
    window holds the spans of one document at a time.
    """
    by_start = Window.partitionBy(*key).orderBy(start, end)
    earlier = F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(earlier.isNull() | (F.col(start) >= earlier), 1).otherwise(0)
    marked = df.withColumn("_opens", opens)
    return marked.withColumn(
        "island", F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_opens")


def merge_findings_table(findings: DataFrame, key: str = "doc_id", mode: str = "greedy") -> DataFrame:
    """Merge findings kept as rows (`key`, `ord` and the finding fields).

    Clusters of overlapping spans are independent of each other, so the greedy
    pass runs per cluster and a document with very many findings is cheap.
    """
    packed = F.sort_array(
        F.collect_list(F.struct(F.col("ord"), F.struct(*FINDING_FIELDS).cast(FINDING).alias("f")))
    )
    merge = merge_findings if mode == "greedy" else cover_findings
    return (
        with_islands(findings, [key])
        .groupBy(key, "island")
        .agg(F.transform(packed, lambda m: m["f"]).alias("members"))
        .select(key, F.explode_outer(merge(F.col("members"))).alias("f"))
        .select(key, "f.*")
    )
