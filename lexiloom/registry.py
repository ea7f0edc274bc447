"""How queries are registered with the SQL that they equal, and what these share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.operators import order, prefixes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_strings(spark: SparkSession, sf_dir: str, name: str, col: str, key: str) -> DataFrame:
    return order.strings(load(spark, sf_dir, name), col, key)


DOCS, URLS, PARTS = ("documents", "text", "doc_id"), ("pages", "url", "page_id"), ("part", "p_name", "p_partkey")


def base(source: tuple[str, str, str]) -> str:
    """SQL of (id, b, h): strings as bytes, and as hex digits, which have the same order."""
    name, col, key = source
    return f"SELECT {key}::BIGINT AS id, encode({col}) AS b, hex(encode({col})) AS h FROM {name} WHERE {col} IS NOT NULL"


def lcp_sql(a: str, b: str) -> str:
    """SQL of the common bytes of two hex strings."""
    short = f"least(length({a}), length({b})) // 2"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, {short} + 1), lambda i: substr({a}, 2 * i - 1, 2) <> substr({b}, 2 * i - 1, 2))), {short} + 1) - 1 END)"


def lcp_table(source: tuple[str, str, str]) -> str:
    return f"""s AS ({base(source)}),
o AS (SELECT id, h, row_number() OVER (ORDER BY h, id) AS rank, lag(h) OVER (ORDER BY h, id) AS p, lead(h) OVER (ORDER BY h, id) AS q FROM s),
t AS (SELECT id, h, rank, coalesce({lcp_sql("p", "h")}, 0)::BIGINT AS lcp, coalesce({lcp_sql("q", "h")}, 0)::BIGINT AS nxt FROM o)"""


def rank_sql(source: tuple[str, str, str], direction: str = "") -> str:
    return f"SELECT id, row_number() OVER (ORDER BY h {direction}, id) AS rank FROM ({base(source)})"


PRIORITY, SEGMENT = ("orders", "o_orderpriority", "o_orderkey"), ("customer", "c_mktsegment", "c_custkey")


def ladder_sql(source: tuple[str, str, str], longest: int) -> str:
    """SQL of the first depth at which a prefix is unique, or the length; depths up to the first above `longest`."""
    tested = prefixes.depths(longest)
    counts = ", ".join(f"count(*) OVER (PARTITION BY n >= {x}, CASE WHEN n >= {x} THEN substr(h, 1, {2 * x}) END) AS c{x}" for x in tested)
    cases = " ".join(f"WHEN n < {x} THEN n WHEN c{x} = 1 THEN {x}" for x in tested)
    return f"WITH s AS (SELECT id, h, length(h) // 2 AS n FROM ({base(source)})), c AS (SELECT *, {counts} FROM s) SELECT id, (CASE {cases} END)::BIGINT AS dp FROM c"
