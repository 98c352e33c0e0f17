"""Checksums and entropy as native expressions."""

from __future__ import annotations

from pyspark.sql import Column

from veilspark.functions.rowsql import column, fresh, let

# Weights of the 11-test over nine digits.
ELEVEN_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, -1)


def bsn_test(value: str) -> str:
    """SQL: nine ASCII digits whose weighted sum is a non-zero multiple of 11."""
    total = " + ".join(
        f"coalesce(try_cast(substring({value}, {i}, 1) AS int), 0) * ({w})" for i, w in enumerate(ELEVEN_WEIGHTS, start=1)
    )
    return f"({value} RLIKE '^[0-9]{{9}}\\\\z' AND {let(total, lambda t: f'{t} % 11 = 0 AND {t} <> 0')})"


def luhn_test(value: str) -> str:
    """SQL: Luhn test on the digits of `value`; separators are ignored."""

    def test(d: str) -> str:
        acc, i = fresh("acc"), fresh("i")
        digit = f"CAST(substring({d}, -{i}, 1) AS int)"
        doubled = f"CASE WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
        total = (
            f"aggregate(sequence(1, length({d})), 0, "
            f"({acc}, {i}) -> {acc} + CASE WHEN {i} % 2 = 0 THEN {doubled} ELSE {digit} END)"
        )
        return f"CASE WHEN length({d}) > 0 THEN {total} % 10 = 0 ELSE false END"

    return let(f"regexp_replace({value}, '[^0-9]', '')", test)


def iban_test(value: str) -> str:
    """SQL: remainder 1 mod 97 of the rearranged, letter-expanded account number."""

    def test(v: str) -> str:
        acc, c = fresh("acc"), fresh("c")
        step = (
            f"CASE WHEN ascii({c}) < 58 THEN ({acc} * 10 + ascii({c}) - 48) % 97 "
            f"ELSE ({acc} * 100 + ascii({c}) - 55) % 97 END"
        )
        remainder = f"aggregate(split(concat(substring({v}, 5), substring({v}, 1, 4)), ''), 0, ({acc}, {c}) -> {step})"
        return f"CASE WHEN length({v}) >= 15 THEN {remainder} = 1 ELSE false END"

    return let(f"upper(regexp_replace({value}, '[^A-Za-z0-9]', ''))", test)


def entropy_of(value: str) -> str:
    """SQL: Shannon entropy of the characters, in bits."""

    def bits(v: str) -> str:
        acc, ch, p = fresh("acc"), fresh("ch"), fresh("p")
        share = f"(length({v}) - length(replace({v}, {ch}, ''))) / length({v})"
        term = f"element_at(transform(array({share}), {p} -> {p} * log2({p})), 1)"
        total = f"aggregate(array_distinct(split({v}, '')), 0D, ({acc}, {ch}) -> {acc} - {term})"
        return f"CASE WHEN length({v}) > 0 THEN {total} ELSE 0D END"

    return let(value, bits)


def valid_bsn(value: Column) -> Column:
    return column(lambda v: bsn_test(v), v=value)


def valid_luhn(value: Column) -> Column:
    return column(lambda v: luhn_test(v), v=value)


def valid_iban(value: Column) -> Column:
    return column(lambda v: iban_test(v), v=value)


def entropy(value: Column) -> Column:
    return column(lambda v: entropy_of(v), v=value)
