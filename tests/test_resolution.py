import random

import pytest

from pyspark.sql import functions as F

import models
from veilspark.operators.merge import cover_findings, merge_findings, merge_findings_table
from veilspark.operators.propagate import PARTICLES, SKIP_WORDS, email_names, propagate, with_propagated
from veilspark.operators.redact import redact
from veilspark.plans.scoped import propagate_scoped
from veilspark.schema import FINDINGS

SKIP = set(SKIP_WORDS) | set(PARTICLES)


def random_findings(rng, length, most=12):
    out = []
    for i in range(rng.randint(0, most)):
        start = rng.randint(0, length - 1)
        end = min(length, start + rng.randint(1, 9))
        out.append((start, end, rng.choice([0.5, 0.75, 0.85, 1.0]), rng.choice(list(models.RANK)), f"t{i}"))
    return out


def as_row(f, text=""):
    return (f[0], f[1], f[2], f[3], f[4], text[f[0] : f[1]], None, None)


def triples(findings):
    return [(f["start"], f["end"], f["score"], f["source"], f["entity_type"]) for f in findings]


def test_merge_cover_and_redact_equal_the_models(spark):
    rng = random.Random(1)
    cases = []
    for i in range(800):
        text = "".join(rng.choices("abcé😀 ", k=40))
        cases.append((i, text, random_findings(rng, 40)))
    df = spark.createDataFrame([(i, t, [as_row(f, t) for f in fs]) for i, t, fs in cases], f"id long, text string, findings {FINDINGS}")
    out = df.withColumn("m", merge_findings(F.col("findings"))).select(
        "id", "m", cover_findings(F.col("findings")).alias("c"), redact(F.col("text"), F.col("m")).alias("r")
    )
    for row in out.collect():
        _, text, findings = cases[row["id"]]
        merged = models.merge(findings)
        assert triples(row["m"]) == merged
        assert row["r"] == models.redact(text, merged)
        assert [(f["start"], f["end"]) for f in row["c"]] == models.cover(findings)
        assert all(a["end"] <= b["start"] for a, b in zip(row["m"], row["m"][1:]))

    rows = df.select("id", F.posexplode("findings").alias("ord", "f")).select(F.col("id").alias("doc_id"), "ord", "f.*")
    table = {}
    for r in merge_findings_table(rows).collect():
        table.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["score"], r["source"], r["entity_type"]))
    for i, _, findings in cases:
        assert sorted(table.get(i, [])) == sorted(models.merge(findings))


def test_overlap_rules(spark):
    cases = {
        "replaced": ([(0, 10, 0.5, "pattern", "a"), (5, 15, 0.9, "pattern", "b")], ["b"]),
        "nested": ([(0, 10, 0.5, "pattern", "a"), (2, 6, 0.9, "pattern", "b")], ["a"]),
        "tie": ([(0, 5, 1.0, "pattern", "a"), (3, 9, 1.0, "secret", "b")], ["b"]),
        "touching": ([(0, 5, 0.5, "lexicon", "a"), (5, 9, 0.5, "lexicon", "b")], ["a", "b"]),
    }
    df = spark.createDataFrame([(k, [as_row(f) for f in fs]) for k, (fs, _) in cases.items()], f"id string, findings {FINDINGS}")
    for row in df.select("id", merge_findings(F.col("findings")).alias("m")).collect():
        assert [f["entity_type"] for f in row["m"]] == cases[row["id"]][1], row["id"]


def test_very_many_findings(spark):
    text = "ab cd é" * 5000
    findings = [(i * 7, i * 7 + 2, 1.0, "pattern", "X") for i in range(5000)]
    df = spark.createDataFrame([(1, text, [as_row(f, text) for f in findings])], f"id long, text string, findings {FINDINGS}")
    row = df.withColumn("m", merge_findings(F.col("findings"))).select(F.size("m").alias("n"), redact(F.col("text"), F.col("m")).alias("r")).first()
    assert row["n"] == 5000
    assert row["r"] == "[X] cd é" * 5000


def test_email_names(spark):
    cases = ["jan.devries@company.nl", "ab@x.nl", "info_van-Piet@x.nl", "j.X1.de.Léa@x", "no address", "a.b@c@d"]
    df = spark.createDataFrame([(c,) for c in cases], "v string").select("v", email_names(F.col("v")).alias("n"))
    for row in df.collect():
        assert row["n"] == models.names_of(row["v"], SKIP)


WORDS = ["jan", "Jan", "JAN", "devries", "a.b", "+31", "de", "het", "x1", "anna", "ANNA", "josé", "😀", "\\E", "info", "an", "jan.devries@x.nl", "JOSÉ"]


def random_document(rng):
    text = "".join(w + rng.choice([" ", " ", ".", ", ", "", "_", "-"]) for w in rng.choices(WORDS, k=rng.randint(1, 25)))
    found = []
    for _ in range(rng.randint(0, 5)):
        a = rng.randint(0, len(text) - 1)
        b = min(len(text), a + rng.randint(1, 8))
        found.append((a, b, rng.choice([0.5, 0.85, None]), rng.choice(["PERSON", "EMAIL_ADDRESS", "email", "T"]), text[a:b]))
    for word in rng.sample(WORDS, 3):
        a = text.find(word)
        if a >= 0:
            label = "EMAIL_ADDRESS" if "@" in word else "W"
            found.append((a, a + len(word), 0.9, label, word))
    return text, found


def documents(spark, n, seed):
    rng = random.Random(seed)
    docs = [random_document(rng) for _ in range(n)]
    rows = [
        (i, i % 7, text, [(a, b, score, "pattern", label, value, None, None) for a, b, score, label, value in found])
        for i, (text, found) in enumerate(docs)
    ]
    return docs, spark.createDataFrame(rows, f"doc_id long, scope long, text string, findings {FINDINGS}")


def claims(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append((r["entity_type"], r["start"], r["end"], r["score"], r["text"], r["reason"]))
    return out


@pytest.mark.parametrize("one_by_one, compared", [(4, 1 << 24), (0, 0), (1 << 20, 0)])
def test_propagation_equals_the_model(spark, monkeypatch, one_by_one, compared):
    monkeypatch.setattr("veilspark.operators.propagate.ONE_BY_ONE", one_by_one)
    monkeypatch.setattr("veilspark.operators.propagate.COMPARED", compared)
    docs, df = documents(spark, 500, 3)
    forms = [df.withColumn("f", propagate(F.col("text"), F.col("findings"))), with_propagated(df, F.col("text"), "findings", "f")]
    for made in forms:
        got = claims(made.select("doc_id", F.explode("f").alias("f")).select("doc_id", "f.*").collect())
        for i, (text, found) in enumerate(docs):
            assert got.get(i, []) == models.propagate(text, found, SKIP), (text, found)


def test_document_scope_equals_in_document_propagation(spark):
    docs, df = documents(spark, 400, 4)
    got = claims(propagate_scoped(df, ["doc_id"]).collect())
    for i, (text, found) in enumerate(docs):
        assert sorted(got.get(i, [])) == sorted(models.propagate(text, found, SKIP)), (text, found)


def test_wide_scope_equals_brute_force(spark):
    """Values of all rows of a scope, rows in id order, searched in each row."""
    docs, df = documents(spark, 120, 5)
    got = claims(propagate_scoped(df, ["scope"]).collect())
    for scope in range(7):
        members = [i for i in range(len(docs)) if i % 7 == scope]
        values = [(v, label, 0.7 if s is None else s, "value-propagation") for i in members for _, _, s, label, v in docs[i][1]
                  if len(v) >= 3 and v.lower() not in SKIP]
        for i in members:
            for _, _, _, label, v in docs[i][1]:
                if label in ("EMAIL_ADDRESS", "email"):
                    values += [(n, "PERSON", 0.5, "email-extraction") for n in models.names_of(v, SKIP) if len(n) >= 3]
        for i in members:
            expected = brute(docs[i][0], docs[i][1], values)
            assert sorted(got.get(i, [])) == sorted(expected), docs[i]


def brute(text, found, values):
    import re

    taken = [(a, b) for a, b, *_ in found if b > a]
    out = []
    for value, label, score, reason in values:
        for m in re.finditer(rf"\b{re.escape(value)}\b", text, re.I):
            if not any(m.start() < b and a < m.end() for a, b in taken):
                taken.append(m.span())
                out.append((label, m.start(), m.end(), score, m.group(), reason))
    return out
