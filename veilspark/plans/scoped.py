"""Scoped propagation: values found in one row are searched in all rows that share
a key (a conversation, a source). With the document id as the scope this equals
the in-document propagation, so it also serves documents with very many values.

Nothing is collected per scope. A bitmap of all values, with their scopes, says of each
place in a text whether a value of its scope may stand there; the places that pass meet
the values in an equi-join on (scope, hash of the folded text). So the exchange holds
about as many rows as there are hits, whatever the size of a scope or of a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.rowsql import column, empty, fold_emit, let, lit, some, struct
from veilspark.functions.text import fold_case
from veilspark.operators.merge import with_islands
from veilspark.operators.places import bitmap, places, shapes_of, with_shape
from veilspark.operators.propagate import caseless, quoted_sql, seeds_sql
from veilspark.schema import CROSSREF

def first_claims(found: DataFrame, scope: list[str], id: str) -> DataFrame:
    """One row per scope and value (compared without case): its first finder, with
    the shape of the value and the join hash."""
    seeds = found.select(id, *scope, F.explode_outer(column(seeds_sql, f=F.col("findings"))).alias("s")).filter(
        F.col("s").isNotNull()
    )
    ordered = F.struct(
        F.col("s.pass"), F.col(id).alias("first_id"), F.col("s.ord"), F.col("s.value"),
        F.col("s.entity_type"), F.col("s.score"), F.col("s.reason"),
    )
    first = (
        seeds.withColumn("_value_key", column(caseless, v=F.col("s.value")))
        .groupBy(*scope, "_value_key")
        .agg(F.min(ordered).alias("m"))
        .select(*scope, "m.*")
    )
    return with_shape(first.withColumn("term", F.col("value")), aligned=True).withColumn("value_hash", F.xxhash64(column(fold_case, v=F.col("value"))))


def _claim_island(members: str, id_type: str) -> str:
    """SQL: greedy claims within one cluster of overlapping places, in claim order.
    Entries of pass 0 are findings and only cover. Of one value's own overlapping
    places the leftmost counts, whether or not it is then covered."""
    kind = "struct<start:int,end:int,score:double,entity_type:string,text:string,reason:string>"
    who = f"struct<first_id:{id_type},ord:int,value:string>"
    state_type = f"struct<covered:array<struct<start:int,end:int>>,claim:struct<pass:int,who:{who}>,upto:int>"

    def step(st: str, m: str) -> str:
        claim = struct(**{"pass": f"{m}.pass", "who": f"{m}.who"})
        repeats = f"{m}.pass > 0 AND {st}.claim IS NOT NULL AND {st}.claim = {claim} AND {m}.start < {st}.upto"

        def decide(free: str) -> str:
            grown = f"concat({st}.covered, array({struct(start=f'{m}.start', end=f'{m}.end')}))"
            covers = f"{m}.pass = 0 OR {free}"
            state = struct(
                covered=f"CASE WHEN {covers} THEN {grown} ELSE {st}.covered END", claim=claim, upto=f"{m}.end"
            )
            out = struct(
                start=f"{m}.start", end=f"{m}.end", score=f"{m}.score", entity_type=f"{m}.entity_type", text=f"{m}.text",
                reason=f"{m}.reason",
            )
            return struct(
                state=f"CAST({state} AS {state_type})",
                emit=f"CASE WHEN {m}.pass > 0 AND {free} THEN array(CAST({out} AS {kind})) ELSE {empty(kind)} END",
            )

        overlap = some(f"{st}.covered", lambda c: f"{m}.start < {c}.end AND {c}.start < {m}.end AND {c}.end > {c}.start")
        skipped = struct(state=st, emit=empty(kind))
        return f"CASE WHEN {repeats} THEN {skipped} ELSE {let(f'NOT {overlap}', decide)} END"

    zero = struct(covered="array()", claim="NULL", upto="0")
    return fold_emit(members, zero, step, state_type, kind) + ".out"


def propagate_scoped(
    df: DataFrame, scope: list[str], id: str = "doc_id", text: str = "text", findings: str = "findings"
) -> DataFrame:
    """Additional findings as rows `(id, start, end, score, source, entity_type,
    text, reason)`.

    `findings` holds the unmerged findings of a row. A value belongs to the row
    with the smallest id that holds it; values of findings come before names from
    addresses. The small tables cut their lineage with a checkpoint, so detection
    runs once and a lost executor does not repeat it.
    """
    found = df.select(id, *[c for c in scope if c != id], F.col(findings).alias("findings"))
    found = found.select("*", F.size("findings").alias("_n")).filter(F.col("_n") > 0).drop("_n").checkpoint()
    scope_cols = [F.col(c).alias(f"_scope_{i}") for i, c in enumerate(scope)]
    keys = [f"_scope_{i}" for i in range(len(scope))]
    claims = first_claims(found.select(id, *scope_cols, "findings"), keys, id).checkpoint()

    scope_hash = f"xxhash64({', '.join(keys)})"
    bits = bitmap(claims, fold_case, scope_hash)
    texts = df.select(F.col(id), *scope_cols, F.coalesce(F.col(text), F.lit("")).alias("_text"), shapes_of(claims).alias("_shapes"))
    at = places(F.col("_text"), F.col("_shapes"), bits, fold_case, F.expr(scope_hash))
    grams = texts.select(id, *keys, F.explode(at).alias("g")).select(
        id, *keys, F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.col("g.text").alias("text"),
        F.xxhash64(column(fold_case, v=F.col("g.text"))).alias("value_hash"),
    )
    same = column(lambda t, v: f"{t} RLIKE concat('(?iu)^', {quoted_sql(v)}, {lit(chr(92) + 'z')})", t=F.col("text"), v=F.col("value"))
    # a scope that is NULL is a scope of its own, as in a group
    on = [grams["value_hash"] == claims["value_hash"], *[grams[k].eqNullSafe(claims[k]) for k in keys]]
    hits = grams.join(claims, on, "inner").filter(same).select(
        grams[id], "start", "end", F.col("pass"), F.struct("first_id", "ord", "value").alias("who"), "score", "entity_type", "text", "reason",
    )
    return resolve_claims(hits, found, id)


def resolve_claims(hits: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """Let claims take their places in order, document by document."""
    id_type = dict(hits.dtypes)[id]
    extents = found.select(id, F.explode("findings").alias("f")).select(
        id, F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.lit(0).alias("pass"),
        F.lit(None).cast(dict(hits.dtypes)["who"]).alias("who"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("reason"),
    )
    places = hits.unionByName(extents.filter(F.col("end") > F.col("start")))
    members = F.array_sort(
        F.collect_list(F.struct("pass", "who", "start", "end", "score", "entity_type", "text", "reason"))
    )
    return (
        with_islands(places, [id])
        .groupBy(id, "island")
        .agg(members.alias("members"))
        .select(id, F.explode_outer(column(lambda m: _claim_island(m, id_type), m=F.col("members"))).alias("o"))
        .filter(F.col("o").isNotNull())
        .select(
            id, F.col("o.start").alias("start"), F.col("o.end").alias("end"), F.col("o.score").alias("score"),
            F.lit(CROSSREF).alias("source"), F.col("o.entity_type").alias("entity_type"), F.col("o.text").alias("text"),
            F.col("o.reason").alias("reason"),
        )
    )
