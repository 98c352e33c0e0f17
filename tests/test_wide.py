import random
import time

from pyspark.sql import functions as F

from veilspark.operators.lexicon import Lexicon
from veilspark.plans.scan import ScanOptions, scan
from veilspark.plans.wide import scan_long, scan_mixed

OPTIONS = ScanOptions(lexicon=Lexicon.of([("Jan", "persoon"), ("Piet", "persoon"), ("Utrecht", "locatie")]))
PIECES = [
    "jan.devries@x.nl", "Jan de Vries", "JAN DE VRIES", "devries", "Piet", "Utrecht", "utrecht", "token=abc123def456ghi789", "abc123def456ghi789",
    "bsn 111222333", "111222333", "10.0.0.1", "06-12345678", "12-03-2021", "de", "😀", "mail", "\n",
]


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(PIECES, k=rng.randint(0, 30))), ("quick", "standard", "deep")[i % 3]) for i in range(n)]


def rows(df):
    return {r["doc_id"]: r.asDict(recursive=True) for r in df.collect()}


def test_long_plan_equals_narrow_plan(spark):
    df = spark.createDataFrame(texts(1, 150), "doc_id long, text string, d string")
    narrow, wide = rows(scan(df, F.col("d"), options=OPTIONS)), rows(scan_long(df, F.col("d"), options=OPTIONS))
    assert narrow.keys() == wide.keys()
    for i in narrow:
        assert narrow[i] == wide[i]


def test_mixed_plan_loses_no_row(spark):
    df = spark.createDataFrame(texts(2, 80), "doc_id long, text string, d string")
    assert rows(scan(df, "deep", options=OPTIONS)) == rows(scan_mixed(df, "deep", options=OPTIONS, long_bytes=150))


def test_one_text_with_very_many_values(spark):
    n = 4000
    text = "; ".join(f"user{i}.naam@host{i % 50}.example.com" for i in range(n)) + " user7 USER9.NAAM@host9.example.com"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.time()
    row = scan_long(df, "deep").first()
    assert row["n_pattern"] >= n and "@" not in row["sanitized"]
    assert time.time() - begin < 120


def test_mixed_plan_keeps_null_and_repeated_ids(spark):
    long = "jan.devries@x.nl en Jan de Vries " * 20
    data = [(None, long), (1, long), (1, long), (1, "kort"), (2, long + "10.0.0.1"), (3, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    parts = [sorted(map(repr, plan(df, "deep", options=OPTIONS).collect())) for plan in (scan, lambda *a, **k: scan_mixed(*a, **k, long_bytes=150))]
    assert len(parts[0]) == 6 and parts[0] == parts[1]
