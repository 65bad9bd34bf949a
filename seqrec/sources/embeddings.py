"""Embedding tables from Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.operators.clean import require_columns
from seqrec.sources.ratings import with_order


def resolve_sources(*, path: str | None = None, paths: Sequence[str] | None = None,
                    path_glob: str | None = None) -> list[str]:
    """Exactly one of the three ways to name the input."""
    given = [v for v in (path, paths, path_glob) if v]
    if len(given) != 1:
        raise ValueError("give exactly one of path, paths and path_glob")
    if path:
        return [path]
    if paths:
        return list(paths)
    return [path_glob]


def read_embeddings(spark: SparkSession, sources: Sequence[str], *, dim: int | None = None,
                    ordered: bool = False) -> DataFrame:
    """``item_id`` and ``embedding`` as array<float>; a vector of another length fails.

    The length is ``dim`` or, without it, that of the longest vector.

    Files, directories and glob patterns (for a numbered family of files) may
    be mixed.
    """
    raw = require_columns(spark.read.parquet(*sources), ["item_id", "embedding"])
    if ordered:
        raw = with_order(raw)
    vector = F.col("embedding").cast("array<float>")
    length = F.lit(dim) if dim is not None else raw.agg(F.max(F.size("embedding"))).scalar()
    fail = F.raise_error(F.concat(F.lit("expected "), length.cast("string"), F.lit(" entries, found "),
                                  F.coalesce(F.size(vector).cast("string"), F.lit("null"))))
    vector = F.when(F.size(vector) == length, vector).otherwise(F.array(fail.cast("float")))
    return raw.select(F.col("item_id").cast("string").alias("item_id"),
                      vector.alias("embedding"), *(["ord"] if ordered else []))
