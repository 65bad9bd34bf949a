"""Dense integer ids for users and items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.functions.text import casefold
from seqrec.operators import skew
from seqrec.session import once

LOOKUP_COLUMNS = ["normalized_id", "original_id", "key"]


def raw_keys(df: DataFrame, column: str, order: Sequence[str], *, source_rank: int = 0,
             fold: bool = False) -> DataFrame:
    """Spellings of one source: ``key``, ``original``, ``first`` = (source, order), ``n_rows``.

    Rows are combined per spelling before anything else, so case folding sees
    each spelling once. The order columns of all sources that are put together
    must have the same types; a lower ``source_rank`` takes precedence.
    """
    first = F.struct(F.lit(source_rank).alias("source"), *[F.col(c) for c in order])
    spelled = df.filter(F.col(column).isNotNull()).select(
        F.col(column).cast("string").alias("original"), first.alias("first"))
    combined = spelled.groupBy("original").agg(F.min("first").alias("first"),
                                               F.count(F.lit(1)).alias("n_rows"))
    key = casefold(F.col("original")) if fold else F.col("original")
    return combined.select(key.alias("key"), "original", "first", "n_rows")


def first_seen(keys: DataFrame) -> DataFrame:
    """One row per key with its first position and spelling, and its row count."""
    return keys.groupBy("key").agg(
        F.min("first").alias("first"),
        F.min_by("original", "first").alias("original_id"),
        F.sum("n_rows").alias("n_rows"),
    )


def new_ids(keys: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Ids of the keys that are not in ``lookup``, in order of first appearance.

    They start after the largest id of the lookup, at 0 without one.
    """
    seen = first_seen(keys).drop("n_rows")
    base = F.lit(0)
    if lookup is not None:
        lookup = once(lookup)
        # both sides hold one row per key
        seen = seen.join(lookup.select("key"), "key", "left_anti")
        largest = lookup.agg(F.coalesce(F.max("normalized_id"), F.lit(-1)).alias("largest"))
        base = largest.scalar() + F.lit(1)
    numbered = skew.number_rows(seen, [], ["first"], "_nth")
    return numbered.select((F.col("_nth") + base).cast("long").alias("normalized_id"),
                           "original_id", "key")


def assign_ids(keys: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """The complete new version of a lookup: existing ids are kept, new keys follow."""
    if lookup is not None:
        lookup = once(lookup)
    fresh = new_ids(keys, lookup)
    return fresh if lookup is None else lookup.select(*LOOKUP_COLUMNS).unionByName(fresh)


def encode(ratings: DataFrame, column: str, lookup: DataFrame, *, fold: bool = False,
           counts: DataFrame | None = None, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Replace the raw values of ``column`` by their ids; unknown values are dropped.

    The lookup is first joined to the distinct spellings, and the rows then
    meet their spelling in a balanced join. ``counts`` (original, n_rows), a
    written table as from :func:`raw_keys`, saves a pass over the rows.
    """
    ids = lookup.select("key", F.col("normalized_id").alias("_id"))
    text = F.col(column).cast("string")

    def key_of(value):
        return casefold(value) if fold else value

    spelled = ratings.withColumn("original", text)
    # counts that were given are a table, which can be looked at first
    look = counts is not None
    if counts is None:
        counts = skew.key_counts(spelled.filter(text.isNotNull()), ["original"])
    known = counts.select("original", key_of(F.col("original")).alias("key")).join(ids, "key")
    joined = skew.spread_join(spelled, known.select("original", "_id"), ["original"],
                              counts=counts.select("original", "n_rows"), hot_rows=hot_rows, look=look)
    return joined.withColumn(column, F.col("_id")).select(*ratings.columns)


def item_statistics(lookup: DataFrame, *, num_items: int | None = None, max_id: int | None = None) -> DataFrame:
    """``num_items`` and ``max_id`` of a lookup.

    Configured values are checked against the lookup; one that is not what the
    lookup holds fails the job when the row is read.
    """
    found = lookup.agg(F.count(F.lit(1)).alias("num_items"), F.max("normalized_id").alias("max_id"))
    checked = {}
    for name, value in (("num_items", num_items), ("max_id", max_id)):
        if value is not None:
            wrong = F.raise_error(F.concat(F.lit(f"{name} is configured as {value}, the lookup has "),
                                           F.coalesce(F.col(name).cast("string"), F.lit("none"))))
            checked[name] = F.when(F.col(name).eqNullSafe(F.lit(value)), F.col(name)).otherwise(wrong.cast("long"))
    return found.withColumns(checked) if checked else found


def item_universe(lookup: DataFrame, shift: int = 1) -> DataFrame:
    """All candidate ids; 0 is left free for padding."""
    return lookup.select((F.col("normalized_id") + shift).alias("item_id"))
