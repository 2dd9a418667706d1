"""Registration of queries, each with SQL that gives the same rows on the oracle engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.values import NUMBER, PLACEHOLDERS, value_freq
from ..sources.dirty import COLUMNS, CTE, ROW, dirty_orders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query. In its SQL, WITH $D gives the relation d, WITH $F also its value frequencies f."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.replace("$D", CTE).replace("$F", f"{CTE}, {FREQ}")
        return f
    return add


def quoted(c: str) -> str:
    return '"' + c + '"'


def number(x: str) -> str:
    """try_number in SQL."""
    return rf"(CASE WHEN regexp_full_match(CAST({x} AS VARCHAR), '{NUMBER}') THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END)"


def union(part: Callable[[str, int], str], columns=COLUMNS) -> str:
    return " UNION ALL ".join(part(c, i) for i, c in enumerate(columns))


FREQ = "c AS (" + union(lambda c, i: f"SELECT row_id, '{c}' AS \"column\", {i} AS position, CAST({quoted(c)} AS VARCHAR) AS value FROM d") + '), f AS (SELECT "column", position, value, count(*) AS cnt FROM c GROUP BY ALL)'
TOKENS = "(" + ", ".join("'" + t + "'" for t in PLACEHOLDERS) + ")"


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    return dirty_orders(spark, sf)


def frequencies(spark: SparkSession, sf: str, columns=None) -> DataFrame:
    return value_freq(dirty_orders(spark, sf), ROW, columns)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
