"""Register a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.functions import arrays

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None


REGISTRY: dict[str, Check] = {}


def check(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        REGISTRY[name or function.__name__] = Check(function, sql)
        return function

    return register


# The interactions view in SQL, and the total order of its rows.
ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
ORDER_DESC = ", ".join(f"{c} DESC" for c in ORDER.split(", "))
INTERACTIONS = """inter AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
         CAST(epoch(l_shipdate) AS BIGINT) AS ts,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ser_label,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
AGED = INTERACTIONS + f""", aged AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {ORDER_DESC}) AS INTEGER) AS age,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY {ORDER}) - 1 AS INTEGER) AS pos,
         count(*) OVER (PARTITION BY user_id) AS n_events
  FROM inter)"""
VECTORS = """ivec AS (
  SELECT p_partkey AS item_id, CAST(embedding AS DOUBLE[]) AS v
  FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""


def hash_number(text: str, digits: int = 8) -> str:
    """SQL for the first hex digits of the md5 of ``text`` as a number."""
    return f"CAST(concat('0x', substr(md5({text}), 1, {digits})) AS BIGINT)"


def vector_text(expression: str, digits: int = 6) -> str:
    """SQL for a vector as comma separated text, in units of the last digit."""
    return (f"array_to_string(list_transform({expression}, "
            f"lambda x: CAST(round(x * 1e{digits}) AS BIGINT)), ',')")


def vector_units(column: Column | str, digits: int = 6) -> Column:
    """The same on Spark."""
    return arrays.format_sequence(
        F.transform(column, lambda x: F.round(x * 10.0 ** digits).cast("long")))
