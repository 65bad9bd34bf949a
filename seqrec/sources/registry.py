"""Item readers by data set type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqrec.operators.item_text import movie_text, product_text
from seqrec.sources.catalogue import read_movies, read_products

Reader = Callable[[SparkSession, str], DataFrame]

READERS: dict[str, Reader] = {
    "products": lambda spark, path: product_text(read_products(spark, path)),
    "movies": lambda spark, path: movie_text(read_movies(spark, path)),
}


def register(name: str, reader: Reader) -> None:
    READERS[name] = reader


def read_items(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """(item_id, text) of a registered data set type."""
    if kind not in READERS:
        raise ValueError(f"unknown data set type {kind}; known: {sorted(READERS)}")
    return READERS[kind](spark, path)
