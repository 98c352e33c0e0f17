import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.catalog.detection import PACK_SAMPLES
from veilspark.operators.secrets import DEFAULT_RULES, detect_secrets
from veilspark.plans.scan import ScanOptions, scan
from veilspark.sources.rulepacks import FORMATS, format_pack, java_pattern, parse_pack, read_pack

PATTERNS = [
    r"\bkey\b", r"[a[&&b]+", r"[]x]+", r"[^]x]+", r"(?P<the_name>a+)(b)?", r"(?i)KEY[\s:=]+(\w+)", r"\Qa.b[\E+", r"[[:alpha:]]+[[:^digit:]]",
    r"a\sb", r"[\s,]+", r"\Bey", r"(?:a|b)+$", r"(?m)^b+$", r"[[:word:]-]+", r"\x61{1,2}", r"(?i:A)B", r"[a\]]+", r"[\w.=-]{2,4}", r"\S+",
]
SIGNS = ["a", "b", "key", "KEY", " ", "\n", "\x0b", "é", "1", "_", "-", "[", "]", "&", "x", ".", "a.b[", "=", ":", ",", "B"]


def test_patterns_match_as_in_the_linear_time_dialect(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(12))) for _ in range(400)]
    made = [java_pattern(p) for p in PATTERNS]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    got = df.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"p{i}") for i, (p, _) in enumerate(made)]).collect()
    con = duckdb.connect()
    for i, pattern in enumerate(PATTERNS):
        want = con.execute("SELECT regexp_extract_all(t, ?, 0) FROM (SELECT unnest(?) AS t)", [pattern, texts]).fetchall()
        assert [r[i] for r in got] == [w[0] for w in want], pattern
    assert [n for _, n in made][4:6] == [2, 1]


@pytest.mark.parametrize("pattern", [r"(?U)a+", r"a(?=b)", r"a\Cb", r"(a)\8", r"[[:odd:]]", "a\\"])
def test_patterns_without_the_same_meaning_are_refused(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def test_fields_that_are_not_known_are_refused():
    rule = '[[rules]]\nid = "a"\nregex = "a(b)"\n'
    for more in ("path = 'x'", "secretGroup = 2", "allowlist = {regexTarget = 'line'}", "allowlist = {commits = ['x']}"):
        with pytest.raises(ValueError):
            parse_pack(rule + more)
    with pytest.raises(ValueError):
        parse_pack(rule + rule)
    assert parse_pack("").rules == ()


def test_a_pack_in_a_scan(spark, tmp_path):
    file = tmp_path / "rules.toml"
    file.write_text(
        "[allowlist]\nregexes = ['^ab+$']\nstopwords = ['demo.']\npaths = ['(?:^|/)vendor/']\n"
        "[[rules]]\nid = 'own'\nregex = '''(own)-([a-z.0-9]{4,})'''\nsecretGroup = 2\nentropy = 1.5\nkeywords = ['OWN-']\n"
        "allowlists = [{regexes = ['^zz']}]\n[[rules]]\nid = 'whole'\nregex = 'wh-[0-9]+'\n"
    )
    pack = read_pack(spark, str(file))
    rows = [
        (1, "x own-abcd y", "src/a"), (2, "x own-abbbb y", "src/a"), (3, "x own-aaaa y", "src/a"), (4, "own-zzabcd", "src/a"),
        (5, "own-mydemo.1", "src/a"), (6, "own-abcd", "src/vendor/a"), (7, "wh-12", None), (8, None, "src/a"), (9, "", "vendors/a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    options = ScanOptions(secret_rules=pack.rules, allowed_values=pack.allow, allowed_paths=pack.paths)
    got = {r.doc_id: [(f.entity_type, f.text) for f in r.findings or []] for r in scan(docs, "quick", keep=["path"], path=F.col("path"), options=options).collect()}
    assert got[1] == [("own", "abcd")] and got[7] == [("whole", "wh-12")]
    assert not any(got[i] for i in (2, 3, 4, 5, 6, 8, 9))


def test_formats_have_a_sample_each_and_are_not_in_the_default_rules(spark):
    pack = format_pack()
    assert [r.name for r in pack.rules] == list(PACK_SAMPLES) and len(pack.rules) >= 25
    assert not {r.name for r in pack.rules} & {r.name for r in DEFAULT_RULES} and FORMATS.exists()
    # each rule finds its sample behind its own keyword test, at the end of a text too
    one = spark.range(7, 8).withColumnRenamed("id", "c_custkey")
    for rule in pack.rules:
        text = F.expr(f"concat('k ', {', '.join(PACK_SAMPLES[rule.name])})")
        found = one.select(text.alias("t")).select("t", F.size(detect_secrets(F.col("t"), [rule])).alias("n")).first()
        assert found.n == 1, (rule.name, found.t)
