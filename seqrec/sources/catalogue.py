"""Item catalogues and item metadata."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.functions.text import strip
from seqrec.sources.ratings import with_order

PRODUCT_TYPE = ("asin string, title string, description string, "
                "categories array<array<string>>, valid boolean")


def catalogue_ids(lines: DataFrame, *, line: str = "value", order: str = "ord") -> DataFrame:
    """First field of every line, cleaned, distinct, with its first position.

    Byte order mark, quotes and blanks are removed; a header in the first line
    and empty fields are dropped.
    """
    field = strip(F.split(F.col(line), ",", 2)[0])
    field = strip(F.regexp_replace(F.regexp_replace(field, r"^\uFEFF", ""), '^"+|"+$', ""))
    cleaned = lines.select(field.alias("item_id"), F.col(order).alias("ord"))
    start = lines.agg(F.min(order).alias("start")).scalar()
    header = (F.lower("item_id") == "movieid") & (F.col("ord") == start)
    kept = cleaned.filter((F.col("item_id") != "") & ~header)
    return kept.groupBy("item_id").agg(F.min("ord").alias("ord"))


def read_catalogue_ids(spark: SparkSession, path: str) -> DataFrame:
    return catalogue_ids(with_order(spark.read.text(path)))


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV by header name; values may span lines."""
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", True).csv(path))


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _branches(value) -> list[list[str]]:
    """The three forms (text, list of text, list of lists) as a list of lists."""
    if value is None:
        return []
    if isinstance(value, str):
        return [[value]]
    return [[entry] if isinstance(entry, str) else [s for s in entry if isinstance(s, str)]
            for entry in value]


def _parse_products(lines: pd.Series) -> pd.DataFrame:
    rows: list[tuple] = []
    for line in lines:
        try:
            record = ast.literal_eval(line.strip())
            asin = record.get("asin")
            rows.append((None if asin is None else str(asin).strip(), _text(record.get("title")),
                         _text(record.get("description")), _branches(record.get("categories")),
                         True))
        except (SyntaxError, ValueError, AttributeError, TypeError):
            rows.append((None, None, None, [], False))
    return pd.DataFrame(rows, columns=["asin", "title", "description", "categories", "valid"])


def parse_products(lines: DataFrame, *, line: str = "value") -> DataFrame:
    """Python-literal records, one per line; ``valid`` is false where a line is malformed.

    JSON functions return nothing for such lines (None, True, u'..'), so the
    literal parser runs in a vectorised function.
    """
    kept = lines.filter(strip(F.col(line)) != "")
    parse = F.pandas_udf(_parse_products, PRODUCT_TYPE)
    return kept.select(parse(F.col(line)).alias("_p")).select("_p.*")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed product records that have an id, ready for ``product_text``."""
    parsed = parse_products(spark.read.text(path))
    return parsed.filter(F.col("valid") & (F.coalesce(F.col("asin"), F.lit("")) != "")) \
                 .select(F.col("asin").alias("item_id"), "title", "description", "categories")


def malformed_lines(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(~F.col("valid")).alias("malformed"),
                      F.count(F.lit(1)).alias("lines"))


