"""Rating logs from CSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.operators.clean import rename_known, require_columns

# Column names of the public rating files.
RENAMES = {"userId": "user_id", "movieId": "item_id", "unix_timestamp": "ts", "timestamp": "ts"}
FLAG_COLUMNS = ["s_ser_find", "s_ser_imp", "s_ser_rec", "m_ser_find", "m_ser_imp", "m_ser_rec"]
HEADERLESS = "user_id string, item_id string, rating double, ts double"


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Add the position of each row in its input: file, split, row within the split.

    Use it directly on a file scan; the running id restarts per split and is
    ascending inside it.
    """
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def read_ratings(spark: SparkSession, path: str | Sequence[str], *, extra: Sequence[str] = (),
                 ordered: bool = True) -> DataFrame:
    """CSV with a header; all values as text, known names unified, columns checked."""
    raw = spark.read.option("header", True).csv(path)
    if ordered:
        raw = with_order(raw)
    named = rename_known(raw, RENAMES)
    wanted = ["user_id", "item_id", "rating", "ts", *extra]
    return require_columns(named, wanted).select(*wanted, *(["ord"] if ordered else []))


def read_headerless_ratings(spark: SparkSession, path: str | Sequence[str], *,
                            ordered: bool = True) -> DataFrame:
    """CSV of exactly user, item, rating, timestamp without a header."""
    raw = spark.read.schema(HEADERLESS).option("header", False).csv(path)
    return with_order(raw) if ordered else raw


def read_columns(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                 fallbacks: dict[str, str] | None = None, *, ordered: bool = False) -> DataFrame:
    """Only the named columns of a CSV file; ``fallbacks`` gives alternative names."""
    raw = spark.read.option("header", True).csv(path)
    present = set(raw.columns)
    if ordered:
        raw = with_order(raw)
    missing = {a: b for a, b in (fallbacks or {}).items() if a not in present and b in present}
    raw = raw.withColumnsRenamed({b: a for a, b in missing.items()})
    return require_columns(raw, columns).select(*columns, *(["ord"] if ordered else []))


def read_sequences(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The text form of the sequence table, columns as in the file."""
    return spark.read.option("header", True).csv(path)
