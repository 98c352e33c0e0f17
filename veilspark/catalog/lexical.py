"""Queries of the lexicon layer and the lookup-list entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog.base import bsn_sql, derived, derived_sql, plain, query, spans_sql
from veilspark.catalog.detection import BSN9, EMAIL_RE2, MOB8
from veilspark.operators import lexicon as lex

# Customers with the name of their nation and region; the lists are the nation
# and region tables.
PLACE_TEXT = "concat('Klant ', c_name, ' woont in NATION_', c_nationkey, ', niet in NATION_', c_nationkey + 1, 'x of nation_1 maar NATION_', c_nationkey * 7 % 30, '.')"
PLACE_SQL = derived_sql("customer", "c_custkey", PLACE_TEXT)


def order_terms(spark, sf_dir, tag):
    """Two terms for each order, `Partij 7` and `Partij 7 B.V.`: tens of thousands on all but the smallest tables."""
    orders = plain(spark, sf_dir, "orders").select(F.concat(F.lit("Partij "), F.col("o_orderkey")).alias("term"), F.lit(tag).alias("tag"))
    return orders.unionByName(orders.withColumn("term", F.concat("term", F.lit(" B.V."))))


def long_list(spark, sf_dir, terms, tag):
    """A few terms among very many."""
    return spark.createDataFrame(terms, "term string, tag string").unionByName(order_terms(spark, sf_dir, tag))


def nation_list(spark, sf_dir):
    nations = plain(spark, sf_dir, "nation").select(F.col("n_name").alias("term"), F.lit(lex.PLACE_TAG).alias("tag"))
    regions = plain(spark, sf_dir, "region").select(F.col("r_name").alias("term"), F.lit(lex.ORG_TAG).alias("tag"))
    return nations.unionByName(regions)


def listed_sql(label: str, score: str) -> str:
    return f"""
    SELECT s.doc_id, {label} AS entity_type, s.start, s."end", CAST({score} AS DOUBLE) AS score, s.text
    FROM ({spans_sql(PLACE_SQL, r"[\p{L}\p{N}_]+")}) s JOIN nation ON n_name = s.text"""


def rows(df, findings):
    found = df.select("doc_id", F.explode_outer(findings).alias("f")).filter(F.col("f").isNotNull())
    return found.select("doc_id", "f.entity_type", "f.start", "f.end", "f.score", "f.text")


def places(spark, sf_dir):
    return derived(spark, sf_dir, "customer", "c_custkey", PLACE_TEXT)


def listed(docs, terms):
    return lex.with_listed(docs, terms)


def layer(docs, terms):
    """The lexicon layer of a table of terms, without its pattern rules."""
    return rows(listed(docs, terms), lex.detect_lexicon(F.col("text"), F.col("_listed"), ()))


def entities(docs, terms):
    return rows(listed(docs, terms), lex.detect_entities(F.col("text"), F.col("_listed")))


query("c17_lookup_list", listed_sql("'locatie'", "0.75"))(lambda spark, sf_dir: layer(places(spark, sf_dir), nation_list(spark, sf_dir)))
query("c12_8_location", listed_sql("'LOCATION'", "0.85"))(
    lambda spark, sf_dir: entities(places(spark, sf_dir), nation_list(spark, sf_dir).unionByName(order_terms(spark, sf_dir, lex.ORG_TAG)))
)

# Terms of two and more words that end in a sign: the longest that no word character follows.
PARTY_TEXT = "concat('Van Partij ', c_custkey, ' B.V. aan Partij ', c_custkey * 3, ' B.V.x en Partij ', c_nationkey, ' B.V.')"
query(
    "c17_lookup_list_join",
    """
    WITH o AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS BIGINT) AS c FROM customer),
    m AS (
      SELECT k AS doc_id, k AS named, 4 AS start, 'Partij ' || k || ' B.V.' AS text FROM o
      UNION ALL SELECT k, k * 3, 4 + length('Partij ' || k || ' B.V. aan '), 'Partij ' || (k * 3) FROM o
      UNION ALL SELECT k, c, 4 + length('Partij ' || k || ' B.V. aan Partij ' || (k * 3) || ' B.V.x en '), 'Partij ' || c || ' B.V.' FROM o)
    SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end", 'organisatie' AS tag, text
    FROM m WHERE named IN (SELECT o_orderkey FROM orders)""",
)(lambda spark, sf_dir: lex.lexicon_join(derived(spark, sf_dir, "customer", "c_custkey", PARTY_TEXT), order_terms(spark, sf_dir, lex.ORG_TAG)))

ORG_TEXT = "concat('order ', o_orderkey, ' van ', CASE o_orderkey % 4 WHEN 0 THEN 'Stichting De Brug' WHEN 1 THEN 'UMC Oost' WHEN 2 THEN 'stichting de brug' ELSE 'UMC Oosterhout' END, ' ontvangen')"
ORGS = [("Stichting De Brug", lex.ORG_TAG), ("UMC Oost", lex.HOSPITAL_TAG), ("Stichting De", lex.ORG_TAG)]
query(
    "c12_9_organization",
    f"""SELECT doc_id, 'ORGANIZATION' AS entity_type, start, "end", CAST(0.85 AS DOUBLE) AS score, text
    FROM ({spans_sql(derived_sql("orders", "o_orderkey", ORG_TEXT), r"Stichting De Brug|UMC Oost\b")})""",
)(
    lambda spark, sf_dir: entities(
        derived(spark, sf_dir, "orders", "o_orderkey", ORG_TEXT), long_list(spark, sf_dir, ORGS, lex.PLACE_TAG)
    )
)

NAME = "CASE c_custkey % 6 WHEN 0 THEN 'Jan de Vries' WHEN 1 THEN 'Piet van der Berg-Smit' WHEN 2 THEN 'Karel de Grote' WHEN 3 THEN 'Jan' WHEN 4 THEN 'Janneke Bos' ELSE 'Jan Piet Klaas' END"
PERSON_TEXT = f"concat('Mevrouw sprak met ', {NAME}, ' uit Utrecht over zaak ', c_custkey)"
NAMES = [("Jan", lex.PERSON_TAG), ("Piet", lex.PERSON_TAG)]


def person_sql(label: str, score: str) -> str:
    return f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, '{label}' AS entity_type, CAST(18 AS BIGINT) AS start, CAST(18 + length(n) AS BIGINT) AS "end",
      CAST({score} AS DOUBLE) AS score, n AS text FROM (SELECT c_custkey, {NAME} AS n FROM customer) WHERE regexp_matches(n, '^(Jan|Piet)( |$)')"""


def persons(spark, sf_dir):
    return derived(spark, sf_dir, "customer", "c_custkey", PERSON_TEXT)


query("c12_7_person", person_sql("PERSON", "0.85"))(lambda spark, sf_dir: entities(persons(spark, sf_dir), long_list(spark, sf_dir, NAMES, lex.PERSON_TAG)))
query("c18_person_particles", person_sql("persoon", "0.75"))(
    lambda spark, sf_dir: layer(persons(spark, sf_dir), long_list(spark, sf_dir, NAMES, lex.PERSON_TAG))
)

DATE_TEXT = (
    "concat('Op ', c_custkey % 28 + 1, '-', c_custkey % 12 + 1, '-20', lpad(CAST(c_custkey % 30 AS STRING), 2, '0'), ' en ', c_custkey % 31 + 1, ' ', "
    "CASE c_custkey % 3 WHEN 0 THEN 'maart 2021' WHEN 1 THEN 'Mei' ELSE 'brumaire' END, ', niet 45/99/2020 of 1-2/2020; leeftijd ', c_custkey % 100, "
    "CASE c_custkey % 3 WHEN 0 THEN ' jaar' WHEN 1 THEN '-jarige' ELSE ' jaargang' END, ', patientnr. ', c_custkey * 7919 + 10000)"
)
DATE_SQL = derived_sql("customer", "c_custkey", DATE_TEXT)
DATE_RE2 = (
    r"\b(?:0?[1-9]|[12][0-9]|3[01])(?:-(?:0?[1-9]|1[0-2])-|/(?:0?[1-9]|1[0-2])/|\.(?:0?[1-9]|1[0-2])\.)(?:(?:19|20)[0-9]{2}|[0-9]{2})\b"
    r"|\b(?:0?[1-9]|[12][0-9]|3[01]) (?i:" + "|".join(lex.MONTHS) + r")(?: (?:19|20)[0-9]{2})?\b"
)


def dated(spark, sf_dir):
    return derived(spark, sf_dir, "customer", "c_custkey", DATE_TEXT)


def lexicon_rule(rules, docs):
    return lambda spark, sf_dir: rows(docs(spark, sf_dir), lex.detect_lexicon(F.col("text"), None, rules))


query("c19_dates", f"""SELECT doc_id, 'datum' AS entity_type, start, "end", CAST(0.75 AS DOUBLE) AS score, text FROM ({spans_sql(DATE_SQL, DATE_RE2)})""")(
    lexicon_rule([lex.DATE_NUMERIC, lex.DATE_WORDS], dated)
)
query(
    "c20_ages",
    f"""SELECT doc_id, 'leeftijd' AS entity_type, start, start + length(regexp_extract(text, '^[0-9]+')) AS "end", CAST(0.75 AS DOUBLE) AS score,
        regexp_extract(text, '^[0-9]+') AS text FROM ({spans_sql(DATE_SQL, r"(?:1[01][0-9]|[1-9]?[0-9])[ -]?(?i:jaar|jarige)" + chr(92) + "b")})""",
)(lexicon_rule([lex.AGE], dated))
query(
    "c21_patient_number",
    f"""SELECT doc_id, 'patientnummer' AS entity_type, start + length(regexp_extract(text, '^[^0-9]*')) AS start, "end", CAST(0.75 AS DOUBLE) AS score,
        regexp_extract(text, '[0-9]+$') AS text FROM ({spans_sql(DATE_SQL, r"patientnr[.] [0-9]{5,10}" + chr(92) + "b")})""",
)(lexicon_rule([lex.PATIENT], dated))

CONTACT = f"concat('bel 06-', {MOB8}, ', bsn ', {BSN9}, ', mail jan', c_custkey, '@company.nl.')"
CONTACT_SQL = derived_sql("customer", "c_custkey", CONTACT)
query(
    "c22_contact_tags",
    f"""
    SELECT doc_id, 'telefoonnummer' AS entity_type, start, "end", CAST(0.75 AS DOUBLE) AS score, text FROM ({spans_sql(CONTACT_SQL, r"06-[0-9]{8}")})
    UNION ALL SELECT doc_id, 'emailadres', start, "end", 0.75, text FROM ({spans_sql(CONTACT_SQL, EMAIL_RE2)})
    UNION ALL SELECT doc_id, 'bsn', start, "end", 0.75, text FROM ({spans_sql(CONTACT_SQL, "[0-9]{9}")}) WHERE {bsn_sql("text")}
    UNION ALL SELECT doc_id, 'telefoonnummer', start, "end", 0.75, text FROM ({spans_sql(CONTACT_SQL, r"0[1-9][0-9](?:[0-9]){6}")}) WHERE "end" - start = 9 AND NOT starts_with(text, '06-')""",
)(lexicon_rule(lex.LEXICON_RULES, lambda spark, sf_dir: derived(spark, sf_dir, "customer", "c_custkey", CONTACT)))
