"""Queries of propagation, merge and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog.base import documents, q, query, spans_sql, table
from veilspark.catalog.detection import DOCS, EMAIL_RE2, IPV4_RE2, SECRET_RULES, TOKEN_RE2
from veilspark.functions.rowsql import column
from veilspark.functions.spans import spans
from veilspark.operators import propagate as prop
from veilspark.operators.merge import combine, cover_findings, merge_findings, merge_findings_table, ordered_sql
from veilspark.operators.redact import layer_count, project_findings, redact, tag
from veilspark.operators.rules import detect
from veilspark.operators.secrets import detect_secrets
from veilspark.operators.structured import EMAIL, IPV4
from veilspark.plans.scoped import propagate_scoped
from veilspark.schema import NO_FINDINGS, FINDING, FINDINGS, PATTERN

# -- D: propagation -----------------------------------------------------------

WORDS_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(prop.SKIP_WORDS + prop.PARTICLES))
WORD3 = "split_part(replace(text, chr(10), ' '), ' ', 3)"
query(
    "d1_eligible_value",
    f"SELECT doc_id, {WORD3} AS value, (length({WORD3}) >= 3 AND lower({WORD3}) NOT IN ({WORDS_SQL})) AS eligible FROM documents",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", F.expr(WORD3).alias("value"))
    .select("doc_id", "value", prop.eligible(F.col("value")).alias("eligible"))
)

# the word 'the' in any case, between word boundaries, with offsets
query(
    "d2_occurrence_search",
    f"""SELECT doc_id, start, text FROM ({spans_sql(DOCS, r"(?i)\bthe\b")})""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", F.explode_outer(prop.occurrences(F.col("text"), F.lit("THE"))).alias("o"))
    .filter(F.col("o").isNotNull())
    .select("doc_id", "o.start", "o.text")
)

EMAIL_OF = "concat(CASE c_custkey % 5 WHEN 0 THEN 'jan.devries' WHEN 1 THEN 'info_van-Piet' WHEN 2 THEN 'x9' WHEN 3 THEN 'k.l.moerman2.DE' ELSE 'Marie-Louise.x' END, '@company', c_custkey, '.nl')"
query(
    "d3_email_names",
    f"""
    SELECT CAST(c_custkey AS BIGINT) AS c_custkey, coalesce(array_to_string(list_filter(string_split_regex(local, '[._\\-]'),
        lambda p: length(p) >= 2 AND regexp_matches(p, '^[A-Za-z]+$') AND lower(p) NOT IN ({WORDS_SQL})), ','), '') AS names
    FROM (SELECT c_custkey, CASE WHEN length(l) >= 3 THEN l ELSE '' END AS local FROM (SELECT c_custkey, string_split({EMAIL_OF}, '@')[1] AS l FROM customer))""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(prop.email_names(F.expr(EMAIL_OF)), ",").alias("names")
    )
)

# Findings made from order lines: spans per order with scores, layers, input order.
LINE_START, LINE_END = "CAST(l_partkey % 40 AS INT)", "CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INT)"
LINE_SCORE = "CAST((l_partkey % 4 + 1) AS DOUBLE) / 4"
LINE_SOURCE = "CASE l_linenumber % 4 WHEN 0 THEN 'secret' WHEN 1 THEN 'pattern' WHEN 2 THEN 'lexicon' ELSE 'crossref' END"
LINES = f"""SELECT CAST(l_orderkey AS BIGINT) AS doc_id, {LINE_START} AS s, {LINE_END} AS e, {LINE_SCORE} AS score, {LINE_SOURCE} AS source,
  CASE {LINE_SOURCE} WHEN 'secret' THEN 3 WHEN 'pattern' THEN 2 ELSE 1 END AS prio,
  concat('t', l_linenumber) AS entity_type, l_linenumber, l_partkey, l_suppkey FROM lineitem"""


def line_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        F.expr("CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey").alias("ord"),
        F.expr(f"""CAST(named_struct('start', {LINE_START}, 'end', {LINE_END}, 'score', {LINE_SCORE}, 'source', {LINE_SOURCE},
            'entity_type', concat('t', l_linenumber), 'text', NULL, 'description', NULL, 'reason', NULL) AS {FINDING})""").alias("f"),
    )


def line_findings(spark, sf_dir):
    """(doc_id, findings): an order has a handful of lines."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "f"))), lambda x: x["f"]).cast(FINDINGS)
    return line_rows(spark, sf_dir).groupBy("doc_id").agg(packed.alias("findings"))


ORDERED_LINES = f"""SELECT doc_id, s, e, score, source, prio, entity_type,
    row_number() OVER (PARTITION BY doc_id ORDER BY s, score DESC, prio DESC, l_linenumber, l_partkey, l_suppkey) AS pos FROM ({LINES})"""

query(
    "d4_uncovered_matches",
    f"""
    WITH m AS ({spans_sql(DOCS, r"[0-9]{2}")}), c AS ({spans_sql(DOCS, EMAIL_RE2)} UNION ALL {spans_sql(DOCS, IPV4_RE2)})
    SELECT doc_id, start, text FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id AND m.start < c."end" AND c.start < m."end")""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .withColumn("covered", detect(F.col("text"), [EMAIL, IPV4], PATTERN, 0.0))
    .select(
        "doc_id",
        F.explode_outer(
            prop.uncovered(spans(F.col("text"), "[0-9]{2}"), F.transform("covered", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))
        ).alias("o"),
    )
    .filter(F.col("o").isNotNull())
    .select("doc_id", "o.start", "o.text")
)


def email_findings(df):
    return df.withColumn("findings", detect(F.col("text"), [EMAIL], PATTERN, 0.0))


def propagated(df, reason):
    return (
        email_findings(df)
        .select("doc_id", F.explode_outer(prop.propagate(F.col("text"), F.col("findings"))).alias("f"))
        .filter(F.col("f.reason") == reason)
        .select("doc_id", "f.entity_type", "f.start", "f.end", "f.score", "f.text")
    )


# every secret again, in upper case and out of reach of the rule that finds it
ECHO = "CASE WHEN contains(text, 'token = ') THEN concat(text, ' | ', translate(replace(text, 'token = ', 'hash '), 'abcdef', 'ABCDEF'), ' x') ELSE text END"
ECHO_SQL = f"SELECT doc_id, {ECHO} AS text FROM documents"
query(
    "d5_propagate_values",
    f"""
    WITH t AS ({ECHO_SQL}),
    v AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, {q(TOKEN_RE2)}, 1)) AS v FROM t),
    f AS (SELECT doc_id, strpos(text, v) - 1 AS start, strpos(text, v) - 1 + length(v) AS "end" FROM v),
    o AS (SELECT doc_id, v, unnest(range(1, len(string_split(lower(text), lower(v))))) AS k, string_split(lower(text), lower(v)) AS p, text FROM v),
    m AS (SELECT doc_id, v, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(v) AS BIGINT) AS start, text FROM o),
    b AS (SELECT doc_id, start, start + length(v) AS "end", substr(text, start + 1, length(v)) AS text FROM m
          WHERE NOT regexp_matches(substr(text, start, 1), '[\\p{{L}}\\p{{N}}_]')
            AND NOT regexp_matches(substr(text, start + length(v) + 1, 1), '[\\p{{L}}\\p{{N}}_]'))
    SELECT DISTINCT doc_id, 'quoted-secret-assignment' AS entity_type, start, CAST("end" AS BIGINT) AS "end", CAST(1.0 AS DOUBLE) AS score, text FROM b
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = b.doc_id AND b.start < f."end" AND f.start < b."end")""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", F.expr(ECHO).alias("text"))
    .withColumn("findings", detect_secrets(F.col("text"), [SECRET_RULES["quoted-secret-assignment"]]))
    .select("doc_id", F.explode_outer(prop.propagate(F.col("text"), F.col("findings"))).alias("f"))
    .filter(F.col("f.reason") == prop.VALUE_REASON)
    .select("doc_id", "f.entity_type", "f.start", "f.end", "f.score", "f.text")
)

# local parts are `word.NN`, so the name is the word; its other places are persons
query(
    "d5b_propagate_email_names",
    f"""
    WITH f AS ({spans_sql(DOCS, EMAIL_RE2)}),
    n AS (SELECT doc_id, lower(string_split(text, '.')[1]) AS v FROM f
          WHERE length(string_split(text, '.')[1]) >= 3 AND lower(string_split(text, '.')[1]) NOT IN ({WORDS_SQL})
            AND regexp_matches(string_split(text, '.')[1], '^\\p{{L}}+$') GROUP BY ALL),
    w AS ({spans_sql("SELECT doc_id, text FROM documents WHERE contains(text, '@')", r"[\p{L}\p{N}_]+")})
    SELECT w.doc_id, 'PERSON' AS entity_type, w.start, w."end", CAST(0.5 AS DOUBLE) AS score, w.text
    FROM w JOIN n ON w.doc_id = n.doc_id AND lower(w.text) = n.v
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = w.doc_id AND w.start < f."end" AND f.start < w."end")""",
)(lambda spark, sf_dir: propagated(documents(spark, sf_dir), prop.NAME_REASON))

# Conversations: only first turns are searched for addresses; later turns repeat the address and the names in it.
CONV_NO = "concat('4', lpad(CAST((conv_id * 1000003) % 1000000000000000 AS STRING), 15, '0'))"
CONV_TEXT = (
    f"concat(text, CASE WHEN turn = 0 THEN ' mail jansen.klaas@company.nl' WHEN turn % 2 = 1 THEN concat(' nr ', {CONV_NO}, ' Klaas, hello') ELSE ' JANSEN klaasje, Jansen.Klaas@COMPANY.nl' END)"
)

CONV_SQL = f"SELECT conv_id * 100000 + turn AS doc_id, {CONV_TEXT} AS text FROM conversations"


def conversation_findings(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "conv_id", F.expr(CONV_TEXT).alias("text")
    )
    first_only = F.when(F.col("doc_id") % 100000 == 0, F.col("findings")).otherwise(F.expr(NO_FINDINGS))
    return email_findings(turns).withColumn("findings", first_only)


query(
    "d6_scoped_propagation",
    f"""
    WITH t AS (SELECT conv_id * 100000 + turn AS doc_id, conv_id, {CONV_TEXT} AS text FROM conversations),
    e AS (SELECT s.*, conv_id FROM ({spans_sql(CONV_SQL, EMAIL_RE2)}) s JOIN t USING (doc_id)),
    f AS (SELECT * FROM e WHERE doc_id % 100000 = 0),
    again AS (SELECT * FROM e WHERE doc_id % 100000 <> 0 AND (conv_id, lower(text)) IN (SELECT (conv_id, lower(text)) FROM f)),
    taken AS (SELECT doc_id, start, "end" FROM f UNION ALL SELECT doc_id, start, "end" FROM again),
    n AS (SELECT DISTINCT conv_id, lower(v) AS v FROM (SELECT conv_id, unnest(string_split_regex(string_split(text, '@')[1], '[._\\-]')) AS v FROM f)
          WHERE length(v) >= 3 AND regexp_matches(v, '^\\p{{L}}+$') AND lower(v) NOT IN ({WORDS_SQL})),
    w AS ({spans_sql(CONV_SQL, r"[\p{L}\p{N}_]+")})
    SELECT doc_id, conv_id, start, "end", CAST(1.0 AS DOUBLE) AS score, 'EMAIL_ADDRESS' AS entity_type, text FROM again
    UNION ALL SELECT w.doc_id, t.conv_id, w.start, w."end", 0.5, 'PERSON', w.text
    FROM w JOIN t USING (doc_id) JOIN n ON n.conv_id = t.conv_id AND n.v = lower(w.text)
    WHERE NOT EXISTS (SELECT 1 FROM taken f WHERE f.doc_id = w.doc_id AND w.start < f."end" AND f.start < w."end")""",
)(
    lambda spark, sf_dir: propagate_scoped(conversation_findings(spark, sf_dir), ["conv_id"])
    .withColumn("conv_id", F.expr("doc_id div 100000"))
    .select("doc_id", "conv_id", "start", "end", "score", "entity_type", "text")
)

# -- E: merge, redact, result -------------------------------------------------

query(
    "e0_combine_layers",
    f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(concat(source, ':', entity_type), ',' ORDER BY CASE source WHEN 'secret' THEN 0 WHEN 'pattern' THEN 1 WHEN 'lexicon' THEN 2 ELSE 3 END, l_linenumber, l_partkey, l_suppkey) AS seq
    FROM ({LINES}) GROUP BY doc_id""",
)(
    lambda spark, sf_dir: line_findings(spark, sf_dir)
    .select("doc_id", combine(*[F.filter("findings", layer_is(name)) for name in ("secret", "pattern", "lexicon", "crossref")]).alias("a"))
    .select("doc_id", F.size("a").alias("n"), F.array_join(F.transform("a", lambda f: F.concat(f["source"], F.lit(":"), f["entity_type"])), ",").alias("seq"))
)


def layer_is(name: str):
    return lambda f: f["source"] == name


query(
    "e1_order_findings",
    f"SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, CAST(s AS BIGINT) AS start, CAST(score AS DOUBLE) AS score, source, entity_type FROM ({ORDERED_LINES})",
)(
    lambda spark, sf_dir: line_findings(spark, sf_dir)
    .select("doc_id", F.posexplode_outer(column(ordered_sql, f=F.col("findings"))).alias("pos", "o"))
    .select("doc_id", "pos", "o.start", (-F.col("o.neg_score")).alias("score"), "o.source", "o.entity_type")
)

MERGED_SQL = f"""
    WITH RECURSIVE o AS ({ORDERED_LINES}),
    g AS (
      SELECT doc_id, pos, 1 AS slot, s, e, score, source, prio, entity_type FROM o WHERE pos = 1
      UNION ALL
      SELECT g.doc_id, o.pos, CASE WHEN o.s >= g.e THEN g.slot + 1 ELSE g.slot END,
        CASE WHEN o.s >= g.e OR (o.e > g.e AND (o.score > g.score OR (o.score = g.score AND o.prio > g.prio))) THEN o.s ELSE g.s END,
        CASE WHEN o.s >= g.e OR (o.e > g.e AND (o.score > g.score OR (o.score = g.score AND o.prio > g.prio))) THEN o.e ELSE g.e END,
        CASE WHEN o.s >= g.e OR (o.e > g.e AND (o.score > g.score OR (o.score = g.score AND o.prio > g.prio))) THEN o.score ELSE g.score END,
        CASE WHEN o.s >= g.e OR (o.e > g.e AND (o.score > g.score OR (o.score = g.score AND o.prio > g.prio))) THEN o.source ELSE g.source END,
        CASE WHEN o.s >= g.e OR (o.e > g.e AND (o.score > g.score OR (o.score = g.score AND o.prio > g.prio))) THEN o.prio ELSE g.prio END,
        CASE WHEN o.s >= g.e OR (o.e > g.e AND (o.score > g.score OR (o.score = g.score AND o.prio > g.prio))) THEN o.entity_type ELSE g.entity_type END
      FROM g JOIN o ON o.doc_id = g.doc_id AND o.pos = g.pos + 1)
    SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(score AS DOUBLE) AS score, source, entity_type
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slot ORDER BY pos DESC) AS r FROM g) WHERE r = 1"""
query("e2_merge_findings", MERGED_SQL)(
    lambda spark, sf_dir: line_findings(spark, sf_dir)
    .select("doc_id", F.explode_outer(merge_findings(F.col("findings"))).alias("f"))
    .select("doc_id", "f.start", "f.end", "f.score", "f.source", "f.entity_type")
)
query("e3_merge_findings_rows", MERGED_SQL)(
    lambda spark, sf_dir: merge_findings_table(line_rows(spark, sf_dir).select("doc_id", "ord", "f.*")).select(
        "doc_id", "start", "end", "score", "source", "entity_type"
    )
)

query(
    "e4_tags",
    f"""SELECT doc_id, entity_type, source, CASE source WHEN 'secret' THEN '[REDACTED:' || entity_type || ']' WHEN 'pattern' THEN '[' || entity_type || ']' ELSE '[' || upper(entity_type) || ']' END AS tag FROM ({LINES})""",
)(
    lambda spark, sf_dir: line_rows(spark, sf_dir).select(
        "doc_id", "f.entity_type", "f.source", tag(F.col("f.source"), F.col("f.entity_type")).alias("tag")
    )
)

query(
    "e5_redact",
    f"""SELECT doc_id, md5(regexp_replace(text, {q(EMAIL_RE2)}, '[EMAIL_ADDRESS]', 'g')) AS redacted, CAST(length(regexp_replace(text, {q(EMAIL_RE2)}, '[EMAIL_ADDRESS]', 'g')) AS BIGINT) AS n_chars FROM documents""",
)(
    lambda spark, sf_dir: email_findings(documents(spark, sf_dir))
    .select("doc_id", redact(F.col("text"), F.col("findings")).alias("r"))
    .select("doc_id", F.md5("r").alias("redacted"), F.length("r").alias("n_chars"))
)

query(
    "e6_project_findings",
    MERGED_SQL.rsplit("SELECT doc_id, CAST(s", 1)[0]
    + """SELECT doc_id, source, entity_type AS rule, CAST(score AS DOUBLE) AS score, entity_type AS description, CAST(NULL AS VARCHAR) AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slot ORDER BY pos DESC) AS r FROM g) WHERE r = 1""",
)(
    lambda spark, sf_dir: line_findings(spark, sf_dir)
    .select("doc_id", F.explode_outer(project_findings(merge_findings(F.col("findings")))).alias("f"))
    .select("doc_id", "f.*")
)

query(
    "e7_strip_matched_text",
    f"""SELECT doc_id, 'pattern' AS source, 'EMAIL_ADDRESS' AS rule, CAST(1.0 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS text_when_stripped, text AS text_when_debug FROM ({spans_sql(DOCS, EMAIL_RE2)})""",
)(
    lambda spark, sf_dir: email_findings(documents(spark, sf_dir))
    .select(
        "doc_id",
        F.explode_outer(
            F.arrays_zip(project_findings(F.col("findings")).alias("plain"), project_findings(F.col("findings"), debug=True).alias("debug"))
        ).alias("z"),
    )
    .filter(F.col("z").isNotNull())
    .select(
        "doc_id", "z.plain.source", "z.plain.rule", "z.plain.score",
        F.get_json_object(F.to_json("z.plain"), "$.text").alias("text_when_stripped"), F.col("z.debug.text").alias("text_when_debug"),
    )
)

query(
    "e8_layer_counts",
    MERGED_SQL.rsplit("SELECT doc_id, CAST(s", 1)[0]
    + f""", m AS (SELECT doc_id, CAST(max(slot) AS BIGINT) AS n_findings FROM g GROUP BY doc_id)
    SELECT doc_id, CAST(sum((source = 'secret')::INT) AS BIGINT) AS n_secret, CAST(sum((source = 'pattern')::INT) AS BIGINT) AS n_pattern,
      CASE WHEN doc_id % 2 = 0 THEN CAST(sum((source = 'lexicon')::INT) AS BIGINT) END AS n_lexicon, any_value(n_findings) AS n_findings
    FROM ({LINES}) JOIN m USING (doc_id) GROUP BY doc_id""",
)(
    lambda spark, sf_dir: line_findings(spark, sf_dir).select(
        "doc_id",
        layer_count(F.filter("findings", layer_is("secret"))).alias("n_secret"),
        layer_count(F.filter("findings", layer_is("pattern"))).alias("n_pattern"),
        layer_count(F.when(F.col("doc_id") % 2 == 0, F.filter("findings", layer_is("lexicon")))).alias("n_lexicon"),
        F.size(merge_findings(F.col("findings"))).alias("n_findings"),
    )
)

query(
    "e9_cover_merge",
    f"""
    SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end" FROM (
      SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS opens
        FROM ({ORDERED_LINES}))) GROUP BY doc_id, island""",
)(
    lambda spark, sf_dir: line_findings(spark, sf_dir)
    .select("doc_id", F.explode_outer(cover_findings(F.col("findings"))).alias("f"))
    .select("doc_id", "f.start", "f.end")
)
