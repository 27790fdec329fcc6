"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.session import records, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: Tables with re-deliveries as common table expressions: one row a key.
ONE_ROW = {
    "p": "p AS (SELECT DISTINCT ON (pair_id) * FROM preference_pair)",
    "s": "s AS (SELECT DISTINCT ON (response_id) * FROM sampled_response)",
    "j": "j AS (SELECT DISTINCT ON (judgment_id) * FROM step_judgment)",
    "c": "c AS (SELECT DISTINCT ON (conv_id) * FROM conversation_record)",
    "k": "k AS (SELECT DISTINCT ON (sample_id) * FROM packing_sample)",
}


def ctes(names: str) -> str:
    return "WITH " + ", ".join(ONE_ROW[n] for n in names)


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def tokens_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '[\s\p{{Z}}]+'), lambda w: w <> '')"


def number_sql(x: str) -> str:
    return rf"CASE WHEN regexp_matches({strip_sql(x)}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN CAST({strip_sql(x)} AS DOUBLE) END"


def pairs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return records(table(spark, d, "preference_pair"), "pair_id", *columns)


def responses(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return records(table(spark, d, "sampled_response"), "response_id", *columns)


def judgments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return records(table(spark, d, "step_judgment"), "judgment_id", *columns)


def conversations(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return records(table(spark, d, "conversation_record"), "conv_id", *columns)
