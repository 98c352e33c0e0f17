import math
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.checks import entropy, valid_bsn, valid_iban, valid_luhn
from veilspark.functions.rowsql import column
from veilspark.functions.spans import spans
from veilspark.functions.text import decode_text, mask_log, segment_slice, segments, utf16_units
from veilspark.operators.structured import BSN, KVK, NL_PHONE, unicode_form

ALPHABET = ["a", "B", "é", "1", "12", " ", "-", "06", "+31", "0031", "😀", "\n", "_", "²", ".", " ", "123456782", "020"]


def random_texts(seed, n, size=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, size))) for _ in range(n)]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


@pytest.mark.parametrize("pattern", [r"[0-9]+", r"a|é|😀", r"(?s)..", *[r.pattern for r in (BSN, KVK, *NL_PHONE)]])
def test_spans_equal_finditer(spark, pattern):
    values = random_texts(pattern, 300)
    rows = texts(spark, values).select("id", spans(F.col("text"), unicode_form(pattern)).alias("s")).collect()
    for row in rows:
        expected = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, values[row["id"]])]
        assert [tuple(s) for s in row["s"]] == expected, values[row["id"]]


def test_spans_of_many_matches(spark):
    text = "x 12, é" * 3000
    row = texts(spark, [text]).select(spans(F.col("text"), "[0-9]+|é").alias("s")).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == [m.span() for m in re.finditer("[0-9]+|é", text)]


def test_segment_slice(spark):
    rng = random.Random(5)
    cases = []
    for i in range(200):
        text = "".join(rng.choices("ab😀é\n", k=rng.choice([0, 10, 1023, 1024, 1025, 5000])))
        a = rng.randint(0, len(text))
        cases.append((i, text, a, rng.randint(a, len(text))))
    df = spark.createDataFrame(cases, "id long, text string, a int, b int")
    cut = column(lambda t, a, b: segment_slice(segments(t), a, b), t=F.col("text"), a=F.col("a"), b=F.col("b"))
    for row in df.select("*", cut.alias("cut")).collect():
        assert row["cut"] == row["text"][row["a"] : row["b"]]


def check(spark, fn, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", fn(F.col("v")).alias("r")).collect()
    return {r["v"]: r["r"] for r in rows}


def test_checksums(spark):
    assert check(spark, valid_bsn, ["111222333", "123456782", "123456789", "000000000", "12345678", "x11222333", "111222333\n"]) == {
        "111222333": True, "123456782": True, "123456789": False, "000000000": False, "12345678": False, "x11222333": False,
        "111222333\n": False,
    }
    assert check(spark, valid_iban, ["NL91ABNA0417164300", "NL91ABNA0417164301", "NL91 ABNA 0417 1643 00", "GB82WEST12345698765432", ""]) == {
        "NL91ABNA0417164300": True, "NL91ABNA0417164301": False, "NL91 ABNA 0417 1643 00": True, "GB82WEST12345698765432": True,
        "": False,
    }
    assert check(spark, valid_luhn, ["4111111111111111", "4111111111111112", "4111-1111 1111-1111", ""]) == {
        "4111111111111111": True, "4111111111111112": False, "4111-1111 1111-1111": True, "": False,
    }


def test_entropy(spark):
    values = ["", "a", "abab", "0123456789abcdef", "é😀é"]
    for value, bits in check(spark, entropy, values).items():
        shares = [value.count(c) / len(value) for c in set(value)]
        assert math.isclose(bits, -sum(p * math.log2(p) for p in shares), abs_tol=1e-12)


def test_mask_log(spark):
    got = check(spark, mask_log, ["+31 612345678", "+31612345678", "bsn 123456789.", "NL91ABNA0417164300", "06-12345678 é12345678", "1234 AB", "12345AB", None])
    assert got == {
        "+31 612345678": "+31 [FILTERED]",  # the nine-digit rule comes first
        "+31612345678": "[FILTERED]",
        "bsn 123456789.": "bsn [FILTERED].",
        "NL91ABNA0417164300": "[FILTERED]",
        "06-12345678 é12345678": "[FILTERED] é12345678",
        "1234 AB": "[FILTERED]",
        "12345AB": "12345AB",
        None: None,
    }


def test_lengths_and_decoding(spark):
    row = spark.createDataFrame([("a😀é", bytearray(b"\xef\xbb\xbfa\xffb\xe2\x82"))], "t string, b binary").select(
        utf16_units(F.col("t")).alias("n"), decode_text(F.col("b")).alias("d")
    ).first()
    assert row["n"] == 4
    assert row["d"] == "﻿a�b�"
