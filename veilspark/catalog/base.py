"""Registry of the engine's queries and of the SQL that checks them.

Every query reads the given tables whole. SQL texts are written for DuckDB and
use the same column names; integers are compared as BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its checking SQL when it has one."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return widened(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def widened(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is read, for work that shuffles or filters at once."""
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly work on its rows."""
    return spread(plain(spark, sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def derived(spark: SparkSession, sf_dir: str, name: str, id: str, text_sql: str) -> DataFrame:
    """(doc_id, text) with a text made from the columns of a table; the expression
    is valid in Spark and in DuckDB."""
    return table(spark, sf_dir, name).select(F.col(id).cast("bigint").alias("doc_id"), F.expr(text_sql).alias("text"))


def derived_sql(name: str, id: str, text_sql: str) -> str:
    return f"SELECT CAST({id} AS BIGINT) AS doc_id, {text_sql} AS text FROM {name}"


def q(pattern: str) -> str:
    """DuckDB string literal."""
    return "'" + pattern.replace("'", "''") + "'"


def spans_sql(source: str, pattern: str) -> str:
    """SQL of (doc_id, i, start, end, text) of all matches of a RE2 pattern."""
    p = q(pattern)
    return f"""
    SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(s AS BIGINT) AS start, CAST(s + length(ms[i]) AS BIGINT) AS "end", ms[i] AS text
    FROM (
      SELECT doc_id, i, ms,
        list_sum(list_transform(ps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
      FROM (
        SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i
        FROM (
          SELECT doc_id, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS ps
          FROM ({source}) src WHERE regexp_matches(text, {p})
        )
      )
    )"""


def digit_sql(value: str, i: int) -> str:
    return f"CAST(substr({value}, {i}, 1) AS BIGINT)"


def bsn_sql(value: str) -> str:
    weights = (9, 8, 7, 6, 5, 4, 3, 2, -1)
    total = " + ".join(f"{digit_sql(value, i)} * ({w})" for i, w in enumerate(weights, start=1))
    return f"(({total}) % 11 = 0 AND ({total}) <> 0)"


def luhn_sql(value: str) -> str:
    """SQL condition: Luhn test on the digits of `value`."""
    digits = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    return (
        f"(list_sum(list_transform(string_split(reverse({digits}), ''), lambda d, i: "
        "CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(d AS BIGINT) > 4 THEN CAST(d AS BIGINT) * 2 - 9 "
        "ELSE CAST(d AS BIGINT) * 2 END ELSE CAST(d AS BIGINT) END)) % 10 = 0)"
    )


def iban_sql(value: str) -> str:
    """SQL condition: mod-97 test, digit by digit over the letter-expanded number."""
    v = f"upper(regexp_replace({value}, '[^A-Za-z0-9]', '', 'g'))"
    moved = f"string_split(substr({v}, 5) || substr({v}, 1, 4), '')"
    step = (
        "lambda a, c: CASE WHEN ascii(CAST(c AS VARCHAR)) < 58 AND length(CAST(c AS VARCHAR)) = 1 "
        "THEN CAST((CAST(a AS BIGINT) * 10 + ascii(CAST(c AS VARCHAR)) - 48) % 97 AS VARCHAR) "
        "ELSE CAST((CAST(a AS BIGINT) * 100 + ascii(CAST(c AS VARCHAR)) - 55) % 97 AS VARCHAR) END"
    )
    return f"(CAST(list_reduce(list_prepend('0', {moved}), {step}) AS BIGINT) = 1)"
