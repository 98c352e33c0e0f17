"""Queries of the detection operators: matches, secrets, structured identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.catalog.base import (
    bsn_sql, derived, derived_sql, documents, iban_sql, luhn_sql, q, query, spans_sql, table,
)
from veilspark.functions.checks import entropy, valid_bsn, valid_iban, valid_luhn
from veilspark.functions.spans import guarded, no_spans, spans
from veilspark.functions.text import W_END, W_START
from veilspark.operators import secrets as sec
from veilspark.operators import structured as st
from veilspark.operators.rules import Rule, detect
from veilspark.schema import PATTERN
from veilspark.sources.rulepacks import format_pack

DOCS = "SELECT doc_id, text FROM documents"

# RE2 forms of the rule patterns; `\b` is ASCII there.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# without the limits on lengths, as Unicode classes make a counted form too large for RE2
EMAIL_RE2 = r"[\p{L}\p{N}_][\p{L}\p{M}\p{N}._%+&'\-]*@[\p{L}\p{M}\p{N}\-]+(?:\.[\p{L}\p{M}\p{N}\-]+)*\.\p{L}[\p{L}\p{M}]+\b"
CARD_RE2 = r"\b(?:4[0-9]{3}|5[0-5][0-9]{2}|6[0-9]{3}|1[0-9]{3}|3[0-9]{3})[- ]?[0-9]{3,4}[- ]?[0-9]{3,4}[- ]?[0-9]{3,5}\b"
IPV4_RE2 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
TOKEN_RE2 = r"""(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|wachtwoord)["']?\s*(?:=>|:=|[:=])\s*["']([^"'\s]{8,})["']"""

# Dutch texts made from customer keys; every other row has the cue words.
BSN9 = "lpad(CAST((c_custkey * 7919 + 100000000) % 1000000000 AS STRING), 9, '0')"
KVK8 = "lpad(CAST((c_custkey * 104729 + 12345678) % 100000000 AS STRING), 8, '0')"
MOB8 = "lpad(CAST((c_custkey * 15485863) % 100000000 AS STRING), 8, '0')"
CUE = "CASE WHEN c_custkey % 2 = 0 THEN 'bsn' ELSE 'nummer' END"
DUTCH = (
    f"concat('Klant met ', {CUE}, ' ', {BSN9}, '. Over het bedrijf is verder weinig bekend dan ', "
    f"CASE WHEN c_custkey % 3 = 0 THEN 'kamer van koophandel' WHEN c_custkey % 3 = 1 THEN 'kvk' ELSE 'code' END, ' ', {KVK8}, "
    f"'; neem contact op, tel. 06-', {MOB8}, ' of mobiel +31 6 ', {MOB8}, ' dan wel 020-', substr({MOB8}, 1, 7), "
    "' mail jan.devries@company.nl')"
)
DUTCH_SQL = derived_sql("customer", "c_custkey", DUTCH)


def dutch(spark, sf_dir):
    return derived(spark, sf_dir, "customer", "c_custkey", DUTCH)


def found(df, findings, text: bool = True):
    """Finding rows of a findings column."""
    rows = df.select("doc_id", F.explode_outer(findings).alias("f")).filter(F.col("f").isNotNull())
    cols = ["doc_id", "f.entity_type", "f.start", "f.end", "f.score"] + (["f.text"] if text else [])
    return rows.select(*cols)


def rule_query(rule, docs=documents):
    return lambda spark, sf_dir: (lambda df: found(df, detect(F.col("text"), [rule] if isinstance(rule, Rule) else rule, PATTERN, 0.0)))(
        docs(spark, sf_dir)
    )


def rule_sql(entity: str, pattern: str, score: str, keep: str = "true", source: str = DOCS) -> str:
    return f"""
    SELECT doc_id, '{entity}' AS entity_type, start, "end", CAST({score} AS DOUBLE) AS score, text
    FROM ({spans_sql(source, pattern)}) WHERE {keep}"""


# -- matches ------------------------------------------------------------------

query(
    "c1_spans",
    f"""SELECT doc_id, start, "end", text FROM ({spans_sql(DOCS, "[0-9]+")})""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", F.explode_outer(spans(F.col("text"), "[0-9]+")).alias("s"))
    .filter(F.col("s").isNotNull())
    .select("doc_id", "s.start", "s.end", "s.text")
)

query(
    "c2_word_boundaries",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words FROM documents""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir).select(
        "doc_id",
        F.regexp_count("text", F.lit(W_START + r"[\p{L}\p{N}_]+" + W_END)).alias("n_words"),
    )
)

query(
    "c3_guarded_match",
    f"""SELECT doc_id, start, text FROM ({spans_sql("SELECT doc_id, text FROM documents WHERE contains(text, '@')", "@[a-z0-9]+")})""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", F.explode_outer(guarded(F.col("text").contains("@"), spans(F.col("text"), "@[a-z0-9]+"), no_spans())).alias("s"))
    .filter(F.col("s").isNotNull())
    .select("doc_id", "s.start", "s.text")
)


# -- secrets ------------------------------------------------------------------

SECRET_RULES = {r.name: r for r in sec.SECRET_RULES}


def secret_rows(df, rules, **options):
    rows = df.select("doc_id", F.posexplode_outer(sec.detect_secrets(F.col("text"), rules, **options)).alias("pos", "f"))
    return rows.filter(F.col("pos").isNotNull()).select(
        "doc_id", "pos", F.col("f.entity_type").alias("rule"), F.col("f.text").alias("secret"), "f.start", "f.end"
    )


def secret_sql(rule: str, source: str, pattern: str, group: int = 1, keep: str = "true") -> str:
    """Each report maps to the first place of its secret; longest secret first."""
    return f"""
    WITH s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, {q(pattern)}, {group})) AS secret,
                      generate_subscripts(regexp_extract_all(text, {q(pattern)}, {group}), 1) AS i FROM ({source}))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(secret) DESC, i) - 1 AS BIGINT) AS pos,
           '{rule}' AS rule, secret,
           CAST(strpos(text, secret) - 1 AS BIGINT) AS start, CAST(strpos(text, secret) - 1 + length(secret) AS BIGINT) AS "end"
    FROM s WHERE secret <> '' AND ({keep})"""


TWICE = "SELECT doc_id, text || ' ' || text AS text FROM documents"
query("c4_place_secrets", secret_sql("quoted-secret-assignment", TWICE, TOKEN_RE2))(
    lambda spark, sf_dir: secret_rows(
        documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), "text")), [SECRET_RULES["quoted-secret-assignment"]]
    )
)

query(
    "c4_place_secrets_everywhere",
    f"""
    WITH s AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, {q(TOKEN_RE2)}, 1)) AS secret FROM ({TWICE}))
    SELECT doc_id, secret, CAST(list_sum(list_transform(string_split(text, secret)[1:i], lambda x: length(x))) + (i - 1) * length(secret) AS BIGINT) AS start
    FROM (SELECT *, unnest(range(1, len(string_split(text, secret)))) AS i FROM s)""",
)(
    lambda spark, sf_dir: secret_rows(
        documents(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" "), "text")),
        [SECRET_RULES["quoted-secret-assignment"]], all_occurrences=True,
    ).select("doc_id", "secret", "start")
)

HEX = "md5(CAST(c_custkey AS STRING))"
# One text per rule, made from customer keys, with the RE2 form of the rule.
CREDENTIALS = {
    "c5_1_buffer_credential": (
        "buffer-from-credential",
        f"concat('const auth = Buffer.from(''user', c_custkey, ':', substr({HEX}, 1, 10), ''').toString();')",
        r"""Buffer\.from\(\s*["'`]([^"'`\r\n]{6,})["'`]""", "true",
    ),
    "c5_2_basic_auth_header": (
        "basic-auth-header",
        f"concat('Authorization: Basic ', upper(substr({HEX}, 1, 8)), 'x9', {HEX}, '== end; a basic requirement')",
        r"\b(?i:basic)\s+([A-Za-z0-9+/]{10,}={0,2})", r"NOT regexp_matches(secret, '^[A-Z]?[a-z]+$')",
    ),
    "c5_3_quoted_assignment": ("quoted-secret-assignment", None, TOKEN_RE2, "true"),
    "c5_4_plain_text_credential": (
        "plain-text-credential",
        f"concat('Inloggen met login: piet', c_custkey, 'x en wachtwoord is ', substr({HEX}, 1, 12), '-9; password required; username unknown')",
        r"""\b(?i:login|password|username|wachtwoord|gebruikersnaam)(?:\s*:\s*|\s+(?i:is\s+)?)([^\s"'`,;:=<>(){}\[\]]{6,})""",
        r"NOT regexp_matches(secret, '^\p{L}+[.!?]?$')",
    ),
    "c5_5_unquoted_credential": (
        "unquoted-credential",
        f"concat('export DB_PASSWORD=', substr({HEX}, 1, 16), ' token=abc', c_custkey, 'def456ghi789 key=short')",
        r"""(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|wachtwoord)[a-z0-9_]{0,32}=([^\s"'`&;,<>]{8,})""",
        "true",
    ),
    "c5_6_workflow_reference": (
        "workflow-credential-reference",
        f"""concat('{{"type":"http","credentials": {{"httpBasicAuth": {{"id": "', substr({HEX}, 1, 16), '", "name": "acc"}}}}}}')""",
        r'''"credentials"\s*:\s*\{\s*"[^"]*"\s*:\s*\{[^{}]*?"id"\s*:\s*"([^"]+)"''', "true",
    ),
    "c5_8_curl_credential": (
        "curl-credential",
        f"concat('run curl -s -u admin', c_custkey, ':', substr({HEX}, 1, 9), ' https://host/x and done')",
        r"""\bcurl\s[^\r\n]*?(?:-u|--user)[ =]+["']?([^\s"':]+:[^\s"']+)""", "true",
    ),
}


def _register_credentials() -> None:
    for name, (rule, text_sql, pattern, keep) in CREDENTIALS.items():
        source = DOCS if text_sql is None else derived_sql("customer", "c_custkey", text_sql)

        def run(spark, sf_dir, rule=rule, text_sql=text_sql):
            df = documents(spark, sf_dir) if text_sql is None else derived(spark, sf_dir, "customer", "c_custkey", text_sql)
            return secret_rows(df, [SECRET_RULES[rule]])

        query(name, secret_sql(rule, source, pattern, 1, keep))(run)


_register_credentials()

HEX_JSON = f"concat('{{\"hash\": \"', CASE WHEN c_custkey % 5 = 0 THEN repeat('ab', 16) ELSE {HEX} END, '\", \"n\": 1}}')"
ENTROPY_SQL = """(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length({v}) AS p FROM (SELECT unnest(string_split({v}, '')) AS ch) GROUP BY ch))"""
query(
    "c5_7_hex_json_value",
    f"""
    WITH s AS (SELECT doc_id, text, regexp_extract(text, ':\\s*"([0-9a-fA-F]{{32,}})"', 1) AS secret
               FROM ({derived_sql("customer", "c_custkey", HEX_JSON)}))
    SELECT doc_id, CAST(0 AS BIGINT) AS pos, 'hex-json-value' AS rule, secret, CAST(strpos(text, secret) - 1 AS BIGINT) AS start,
           CAST(strpos(text, secret) - 1 + length(secret) AS BIGINT) AS "end"
    FROM s WHERE secret <> '' AND {ENTROPY_SQL.format(v="secret")} >= 3.0""",
)(lambda spark, sf_dir: secret_rows(derived(spark, sf_dir, "customer", "c_custkey", HEX_JSON), [SECRET_RULES["hex-json-value"]]))

# Texts with the publicly documented formats, one format per row by key.
B32 = f"translate(upper({HEX}), '0189', 'GHIJ')"
FORMATS = {
    "cloud-access-key": f"concat('AKIA', substr({B32}, 1, 16))",
    "vcs-token": f"concat('ghp_', {HEX}, 'a1B2')",
    "ci-access-token": f"concat('glpat-', substr({HEX}, 1, 20))",
    "chat-token": f"concat('xoxb-', substr({HEX}, 1, 12), '-', substr({HEX}, 1, 12))",
    "payment-key": f"concat('sk_live_', substr({HEX}, 1, 24))",
    "maps-api-key": f"concat('AIza', {HEX}, 'Q_z')",
    "json-web-token": f"concat('eyJhbGciOiJIUzI1NiIs.ey', {HEX}, '.', {HEX})",
    "private-key": f"concat('-----BEGIN RSA PRIVATE KEY-----', {HEX}, {HEX}, {HEX}, '-----END RSA PRIVATE KEY-----')",
}
FORMAT_VALUE = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(FORMATS.values())) + " END"
FORMAT_NAME = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FORMATS)) + " END"
FORMAT_TEXT = f"concat('see ', {FORMAT_VALUE}, ' for access')"
query(
    "c6_default_rules",
    f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS pos, {FORMAT_NAME} AS rule, {FORMAT_VALUE} AS secret,
        CAST(4 AS BIGINT) AS start, CAST(4 + length({FORMAT_VALUE}) AS BIGINT) AS "end" FROM customer""",
)(lambda spark, sf_dir: secret_rows(derived(spark, sf_dir, "customer", "c_custkey", FORMAT_TEXT), sec.DEFAULT_RULES))

# The rules of the pack, each with a sample of the least length it takes; without its last character it is a near miss.
_L = f"concat({HEX}, md5(concat('a', c_custkey)), {HEX}, md5(concat('b', c_custkey)))"


def _hex(n: int, begin: int = 1) -> str:
    return f"substr({_L}, {begin}, {n})"


PACK_SAMPLES = {
    "package-registry-token": ["'npm_'", _hex(36)],
    "mail-delivery-key": ["'SG.'", _hex(22), "'.'", _hex(43)],
    "newsletter-key": [_hex(32), "'-us7'"],
    "mail-gateway-key": ["'key-'", _hex(32)],
    "telephony-key": ["'SK'", _hex(32)],
    "chat-webhook": ["'https://hooks.slack.com/services/T'", f"upper({_hex(8)})", "'/B'", f"upper({_hex(8, 9)})", "'/'", _hex(24)],
    "voice-chat-webhook": ["'https://discord.com/api/webhooks/12345678901234567/'", _hex(60)],
    "messenger-bot-token": ["'12345678:AA'", _hex(33)],
    "python-index-token": ["'pypi-AgEIcHlwaS5vcmc'", _hex(50)],
    "gem-index-key": ["'rubygems_'", _hex(48)],
    "cloud-host-token": ["'dop_v1_'", _hex(64)],
    "shop-token": ["'shpat_'", _hex(32)],
    "card-terminal-token": ["'sq0atp-'", _hex(22)],
    "secret-manager-token": ["'dp.pt.'", _hex(43)],
    "issue-tracker-key": ["'lin_api_'", _hex(40)],
    "api-client-key": ["'PMAK-'", _hex(24), "'-'", _hex(34)],
    "dashboard-account-token": ["'glsa_'", _hex(32), "'_'", _hex(8)],
    "vault-token": ["'hvs.'", _hex(90)],
    "infrastructure-token": [_hex(14), "'.atlasv1.'", _hex(60)],
    "lakehouse-token": ["'dapi'", _hex(32)],
    "file-encryption-key": ["'AGE-SECRET-KEY-1'", f"translate(upper({_hex(58)}), '1B', 'QP')"],
    "model-hub-token": ["'hf_'", f"translate({_hex(34)}, '0123456789', 'ghijklmnop')"],
    "database-host-token": ["'pscale_tkn_'", _hex(32)],
    "image-registry-token": ["'dckr_pat_'", _hex(27)],
    "monitoring-user-key": ["'NRAK-'", f"upper({_hex(27)})"],
    "parcel-key": ["'EZAK'", _hex(54)],
    "tracing-token": ["'dt0c01.'", f"upper({_hex(24)})", "'.'", f"upper({_hex(64)})"],
    "note-app-token": ["'secret_'", _hex(43)],
}
_KIND = f"CASE CAST(floor(c_custkey / 2) AS BIGINT) % {len(PACK_SAMPLES)} "
PACK_VALUE = _KIND + " ".join(f"WHEN {i} THEN concat({', '.join(v)})" for i, v in enumerate(PACK_SAMPLES.values())) + " END"
PACK_NAME = _KIND + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(PACK_SAMPLES)) + " END"
PACK_TEXT = f"concat('see ', CASE WHEN c_custkey % 2 = 0 THEN {PACK_VALUE} ELSE substr({PACK_VALUE}, 1, length({PACK_VALUE}) - 1) END, ' for access')"
PACK_PATH = "concat(CASE c_custkey % 3 WHEN 0 THEN 'src/vendor/' WHEN 1 THEN 'src/vendors/' ELSE 'src/' END, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '.lock' ELSE '.txt' END)"


query(
    "c6_rule_pack",
    f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS pos, {PACK_NAME} AS rule, {PACK_VALUE} AS secret,
        CAST(4 AS BIGINT) AS start, CAST(4 + length({PACK_VALUE}) AS BIGINT) AS "end" FROM customer WHERE c_custkey % 2 = 0""",
)(lambda spark, sf_dir: secret_rows(derived(spark, sf_dir, "customer", "c_custkey", PACK_TEXT), format_pack().rules, allow=format_pack().allow))


@query(
    "c11_rule_pack_paths",
    f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, {PACK_VALUE} AS secret FROM customer
        WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0""",
)
def c11_rule_pack_paths(spark, sf_dir):
    pack = format_pack()
    docs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("bigint").alias("doc_id"), F.expr(PACK_TEXT).alias("text"), F.expr(PACK_PATH).alias("path")
    )
    found = secret_rows(docs, pack.rules, allow=pack.allow, path=F.col("path"), allowed_paths=pack.paths)
    return found.select("doc_id", "secret")


query(
    "c10_entropy",
    f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(round({ENTROPY_SQL.format(v='p_name')}, 6) AS DOUBLE) AS bits FROM part",
)(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.round(entropy(F.col("p_name")), 6).alias("bits")))

ALLOW_TEXT = (
    "concat('token=', CASE c_custkey % 5 WHEN 0 THEN 'xxxxxxxxxx' WHEN 1 THEN 'your_token_here' WHEN 2 THEN 'changeme1' "
    f"WHEN 3 THEN {HEX} ELSE concat('partner-', {HEX}) END, ' end')"
)
query(
    "c11_allowlist",
    rf"""
    SELECT doc_id, secret FROM (SELECT doc_id, regexp_extract(text, '(?i)token=(\S{{8,}})', 1) AS secret
                                FROM ({derived_sql("customer", "c_custkey", ALLOW_TEXT)}))
    WHERE NOT regexp_matches(secret, '(?i)^(?:x{{4,}}|your[-_].*|changeme.*)$') AND NOT regexp_matches(secret, '^partner-')""",
)(
    lambda spark, sf_dir: secret_rows(
        derived(spark, sf_dir, "customer", "c_custkey", ALLOW_TEXT),
        [SECRET_RULES["unquoted-credential"]], allow=(*sec.ALLOWED_VALUES, "^partner-"),
    ).select("doc_id", "secret")
)

# -- structured identifiers ---------------------------------------------------

query("c12_1_email_address", rule_sql("EMAIL_ADDRESS", EMAIL_RE2, "1.0"))(rule_query(st.EMAIL))
MAILS = "concat('van björn.smit', c_custkey, '@x.nl en o''brien', c_custkey, '@x.ie; josé@mail', c_custkey, '.nl.')"
query(
    "c12_1_email_address_any_script",
    f"""
    WITH m AS (SELECT c_custkey, unnest([concat('björn.smit', c_custkey, '@x.nl'), concat('o''brien', c_custkey, '@x.ie'), concat('josé@mail', c_custkey, '.nl')]) AS text FROM customer)
    SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'EMAIL_ADDRESS' AS entity_type, CAST(instr({MAILS}, text) - 1 AS BIGINT) AS start,
           CAST(instr({MAILS}, text) - 1 + length(text) AS BIGINT) AS "end", CAST(1.0 AS DOUBLE) AS score, text FROM m""",
)(rule_query(st.EMAIL, lambda spark, sf_dir: derived(spark, sf_dir, "customer", "c_custkey", MAILS)))

IBAN_TEXT = (
    "concat('IBAN ', CASE WHEN c_custkey % 2 = 0 THEN 'NL91ABNA0417164300' ELSE "
    f"concat('NL', lpad(CAST(c_custkey % 97 + 2 AS STRING), 2, '0'), 'ABNA0', lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '0')) END, ' dank')"
)
IBAN_RE2 = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
query(
    "c12_2_iban_code",
    rule_sql("IBAN_CODE", IBAN_RE2, "1.0", iban_sql("text"), derived_sql("customer", "c_custkey", IBAN_TEXT)),
)(rule_query(st.IBAN, lambda spark, sf_dir: derived(spark, sf_dir, "customer", "c_custkey", IBAN_TEXT)))

query("c12_3_credit_card", rule_sql("CREDIT_CARD", CARD_RE2, "1.0", luhn_sql("text")))(rule_query(st.CARD))

query("c12_4_ip_address", rule_sql("IP_ADDRESS", IPV4_RE2, "0.6"))(rule_query(st.IPV4))

V6_TEXT = "concat('host 2001:db8::', CAST(c_custkey % 9000 + 1000 AS STRING), ' or ::1, gw fe80:0:0:0:0:0:0:', CAST(c_custkey % 900 + 100 AS STRING), '. up')"
query(
    "c12_4_ip_address_v6",
    rf"""SELECT doc_id, 'IP_ADDRESS' AS entity_type, start, "end", CAST(0.6 AS DOUBLE) AS score, text
    FROM ({spans_sql(derived_sql("customer", "c_custkey", V6_TEXT), r"2001:db8::[0-9]+|::1\b|fe80(?::0){6}:[0-9]+")})""",
)(rule_query([st.IPV4, st.IPV6], lambda spark, sf_dir: derived(spark, sf_dir, "customer", "c_custkey", V6_TEXT)))

query(
    "c12_5_url",
    """SELECT page_id AS doc_id, 'URL' AS entity_type, CAST(4 AS BIGINT) AS start, CAST(4 + length(url) AS BIGINT) AS "end",
       CAST(0.6 AS DOUBLE) AS score, url AS text FROM pages""",
)(
    rule_query(
        [st.URL_SCHEME, st.URL_BARE],
        lambda spark, sf_dir: derived(spark, sf_dir, "pages", "page_id", "concat('see ', url, ' now')"),
    )
)

PHONE_RE2 = r"\+[1-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9](?:[ .\-]?[0-9]){5,12}\b"
query("c12_6_phone_number", rule_sql("PHONE_NUMBER", PHONE_RE2, "0.4"))(rule_query(st.PHONE))

query(
    "c12_10_bsn",
    rule_sql(
        "BSN", r"\b[0-9]{9}\b", "CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.85 END", bsn_sql("text"),
        derived_sql("customer", "c_custkey", f"concat('Klant met ', {CUE}, ' ', {BSN9}, ' ok')"),
    ),
)(rule_query(st.java_form(st.BSN), lambda spark, sf_dir: derived(spark, sf_dir, "customer", "c_custkey", f"concat('Klant met ', {CUE}, ' ', {BSN9}, ' ok')")))

query(
    "c12_11_kvk_number",
    rule_sql("KVK_NUMBER", r"\b[0-9]{8}\b", "CASE WHEN doc_id % 3 = 2 THEN 0.15 ELSE 0.5 END", r"true",
             derived_sql("customer", "c_custkey", DUTCH.replace("06-', ", "06-x', ").replace("+31 6 ', ", "+31 6 x', "))),
)(
    rule_query(
        st.java_form(st.KVK),
        lambda spark, sf_dir: derived(spark, sf_dir, "customer", "c_custkey", DUTCH.replace("06-', ", "06-x', ").replace("+31 6 ', ", "+31 6 x', ")),
    )
)

NL_PHONE_TEXT = (
    f"concat('a 06-', {MOB8}, '; b +31 6 ', {MOB8}, '; c 020-', substr({MOB8}, 1, 7), ', tel 0031', substr('612345678', 1, 9), ';')"
)
_NL = derived_sql("customer", "c_custkey", NL_PHONE_TEXT)
query(
    "c12_12_nl_phone_number",
    f"""
    WITH m AS (
      SELECT doc_id, start, "end", text, 0.7 AS s FROM ({spans_sql(_NL, r"(?:\+31|0031)[\s\-]?[1-9][\s\-]?(?:[0-9][\s\-]?){7,8}")})
      UNION ALL SELECT doc_id, start, "end", text, 0.7 FROM ({spans_sql(_NL, r"\b06[\s\-]?(?:[0-9][\s\-]?){8}\b")})
      UNION ALL SELECT doc_id, start, "end", text, 0.5 FROM ({spans_sql(_NL, r"\b0[1-9][0-9][\s\-]?(?:[0-9][\s\-]?){6,7}\b")}))
    SELECT doc_id, 'NL_PHONE_NUMBER' AS entity_type, start, "end", CAST(score AS DOUBLE) AS score, text FROM (
      SELECT *, CASE WHEN text LIKE '0031%' THEN 1.0 ELSE s END AS score FROM m x
      WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.doc_id = x.doc_id AND y.start <= x.start AND y."end" >= x."end" AND y.s >= x.s
                        AND (y.start, y."end", y.s) <> (x.start, x."end", x.s)))""",
)(rule_query([st.java_form(r) for r in st.NL_PHONE], lambda spark, sf_dir: derived(spark, sf_dir, "customer", "c_custkey", NL_PHONE_TEXT)))

query("c13_1_eleven_test", f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {bsn_sql(BSN9)} AS valid FROM customer")(
    lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", valid_bsn(F.expr(BSN9)).alias("valid"))
)
query(
    "c13_2_iban_mod97",
    f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, {iban_sql('v')} AS valid FROM (SELECT o_orderkey, 'NL' || lpad(CAST(o_orderkey % 97 + 2 AS STRING), 2, '0') || 'ABNA0' || lpad(CAST((o_orderkey * 7919) % 1000000000 AS STRING), 9, '0') AS v FROM orders)",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").select(
        "o_orderkey",
        valid_iban(F.expr("concat('NL', lpad(CAST(o_orderkey % 97 + 2 AS STRING), 2, '0'), 'ABNA0', lpad(CAST((o_orderkey * 7919) % 1000000000 AS STRING), 9, '0'))")).alias("valid"),
    )
)
CARD_NO = "concat('4', lpad(CAST((o_orderkey * 1000003) % 1000000000000000 AS STRING), 15, '0'))"
query("c13_3_luhn", f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, {luhn_sql(CARD_NO)} AS valid FROM orders")(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").select("o_orderkey", valid_luhn(F.expr(CARD_NO)).alias("valid"))
)

PHONE_CUES = "'phone','number','telephone','cell','cellphone','mobile','call'"
# every third document gets a cue in front of its first number sign
CUED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '+', 'Phone is: +') ELSE text END AS text FROM documents"
query(
    "c14_context_boost",
    rf"""
    SELECT s.doc_id, s.start, s.text, CAST(CASE WHEN list_has_any(
        list_filter(string_split_regex(lower(substr(d.text, 1, s.start)), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')[-5:], [{PHONE_CUES}]) THEN 0.75 ELSE 0.4 END AS DOUBLE) AS score
    FROM ({spans_sql(CUED, PHONE_RE2)}) s JOIN ({CUED}) d USING (doc_id)""",
)(
    lambda spark, sf_dir: rule_query(
        st.PHONE,
        lambda s, d: documents(s, d).withColumn(
            "text", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("+"), F.lit("Phone is: +"))).otherwise(F.col("text"))
        ),
    )(spark, sf_dir).select("doc_id", "start", "text", "score")
)

# numbers found by three nested rules of one entity; only the best container stays
NESTED = [
    Rule("NUM", W_START + "[0-9]{13,16}" + W_END, 0.5, hint="[0-9]{13}"),
    Rule("NUM", "[0-9]{6}", 0.5, hint="[0-9]{6}"),
    Rule("NUM", "[0-9]{7}", 0.9, hint="[0-9]{7}"),
]
query(
    "c15_contained_duplicates",
    f"""
    WITH m AS (
      SELECT doc_id, start, "end", text, 0.5 AS score FROM ({spans_sql(DOCS, r"\b[0-9]{13,16}\b")})
      UNION ALL SELECT doc_id, start, "end", text, 0.5 FROM ({spans_sql(DOCS, "[0-9]{6}")})
      UNION ALL SELECT doc_id, start, "end", text, 0.9 FROM ({spans_sql(DOCS, "[0-9]{7}")}))
    SELECT doc_id, start, "end", CAST(score AS DOUBLE) AS score FROM m x
    WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.doc_id = x.doc_id AND y.start <= x.start AND y."end" >= x."end"
                      AND (y.score > x.score OR (y.score = x.score AND (y.start < x.start OR (y.start = x.start AND y."end" > x."end")))))""",
)(lambda spark, sf_dir: rule_query(NESTED)(spark, sf_dir).select("doc_id", "start", "end", "score"))

query(
    "c16_rounded_sorted",
    f"""
    WITH m AS (
      SELECT doc_id, start, 'EMAIL_ADDRESS' AS entity_type, 1.0 AS score FROM ({spans_sql(DOCS, EMAIL_RE2)})
      UNION ALL SELECT doc_id, start, 'IP_ADDRESS', 0.6 FROM ({spans_sql(DOCS, IPV4_RE2)})
      UNION ALL SELECT doc_id, start, 'CREDIT_CARD', 1.0 FROM ({spans_sql(DOCS, CARD_RE2)}) WHERE {luhn_sql("text")})
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, score DESC) - 1 AS BIGINT) AS pos, entity_type, start, CAST(score AS DOUBLE) AS score FROM m""",
)(
    lambda spark, sf_dir: documents(spark, sf_dir)
    .select("doc_id", F.posexplode_outer(detect(F.col("text"), [st.EMAIL, st.CARD, st.IPV4], PATTERN, 0.5)).alias("pos", "f"))
    .filter(F.col("pos").isNotNull())
    .select("doc_id", "pos", "f.entity_type", "f.start", "f.score")
)

# -- extension ----------------------------------------------------------------

TICKET = Rule("TICKET", W_START + r"[a-z]{3,}\.[0-9]{2}" + W_END, 0.3, context=("the", "of"), check="right(value, 2) <> '00'")
query(
    "i1_registered_rule",
    rf"""
    SELECT s.doc_id, s.start, s.text, CAST(CASE WHEN list_has_any(
        list_filter(string_split_regex(lower(substr(d.text, 1, s.start)), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')[-5:], ['the', 'of']) THEN 0.65 ELSE 0.3 END AS DOUBLE) AS score
    FROM ({spans_sql(DOCS, r"\b[a-z]{3,}\.[0-9]{2}\b")}) s JOIN documents d USING (doc_id)
    WHERE right(s.text, 2) <> '00'""",
)(lambda spark, sf_dir: rule_query(TICKET)(spark, sf_dir).select("doc_id", "start", "text", "score"))
