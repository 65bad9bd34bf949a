"""Per-user chronological sequences.

The long form, one row per event with its position, is the main
representation: it can hold a user of any length. Array forms hold a bounded
number of events per row: fixed-size chunks, or the most recent events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.functions import arrays
from seqrec.operators import skew
from seqrec.session import once

EVENT = ["item_id", "rating", "ts"]


def positions(ratings: DataFrame, *, user: str = "user_id", order: Sequence[str] = ("ts", "ord")) -> DataFrame:
    """Add the zero-based chronological position ``pos`` of each event."""
    return skew.number_rows(ratings, [user], order, "pos")


def min_length(ratings: DataFrame, minimum: int, *, user: str = "user_id",
               hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Keep the users with at least ``minimum`` events, before anything is collected."""
    ratings = once(ratings)
    counts = once(skew.key_counts(ratings, [user]))
    enough = counts.filter(F.col("n_rows") >= minimum).select(user)
    return skew.spread_join(ratings, enough, [user], "left_semi", counts=counts, hot_rows=hot_rows, look=True)


def length_statistics(ratings: DataFrame, *, user: str = "user_id") -> DataFrame:
    """Shortest, longest, mean and median sequence length, from per-user counts.

    The median is taken over the distinct lengths (a histogram), so it is
    exact without sorting the users. L distinct lengths need at least L * L / 2
    events, so the histogram stays small.
    """
    lengths = skew.key_counts(ratings, [user])
    histogram = lengths.groupBy("n_rows").agg(F.count(F.lit(1)).alias("users"))
    median = F.percentile("n_rows", F.lit(0.5), F.col("users"))
    users = F.sum("users")
    return histogram.agg(
        F.min("n_rows").alias("min_length"), F.max("n_rows").alias("max_length"),
        (F.sum(F.col("n_rows") * F.col("users")) / users).alias("mean_length"),
        median.cast("double").alias("median_length"), users.alias("users"),
    )


def _event(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def chunked(placed: DataFrame, *, user: str = "user_id", columns: Sequence[str] = EVENT,
            chunk_size: int = 1000) -> DataFrame:
    """Whole sequences as arrays of at most ``chunk_size`` events per row.

    Takes the output of :func:`positions`. Users up to the chunk size have one
    row (chunk 0); longer ones continue in further chunks.
    """
    chunk = F.floor(F.col("pos") / chunk_size).cast("long").alias("chunk")
    ordered = F.array_sort(F.collect_list(_event(["pos", *columns])))
    return placed.groupBy(user, chunk).agg(ordered.alias("_seq")).select(
        user, "chunk", F.transform("_seq", lambda e: F.struct(*[e[c].alias(c) for c in columns]))
        .alias("seq"))


def as_strings(sequences: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace ``seq`` by comma separated text columns, {event field: column name}."""
    kept = [c for c in sequences.columns if c != "seq"]
    return sequences.select(
        *kept, *[arrays.format_sequence(F.col("seq")[field]).alias(name)
                 for field, name in columns.items()])


def from_strings(text: DataFrame, columns: dict[str, tuple[str, str]], *,
                 check: bool = True) -> DataFrame:
    """Parse text columns back, {column: (event field, type)}, to ``seq``.

    With ``check`` parallel columns of different length fail the job.
    """
    parsed = text.withColumns({c: arrays.parse_sequence(F.col(c), kind)
                               for c, (_, kind) in columns.items()})
    if check:
        sizes = F.array(*[F.size(c) for c in columns])
        even = F.size(F.array_distinct(sizes)) == 1
        first = next(iter(columns))
        fail = F.raise_error(F.lit("parallel sequences differ in length"))
        parsed = parsed.withColumn(first, F.when(~even, F.array(fail)
                                                 .cast(f"array<{columns[first][1]}>"))
                                   .otherwise(F.col(first)))
    zipped = F.arrays_zip(*[F.col(c).alias(field) for c, (field, _) in columns.items()])
    return parsed.select(*[c for c in text.columns if c not in columns], zipped.alias("seq"))


def recent(ratings: DataFrame, keep: int, *, user: str = "user_id",
           order: Sequence[str] = ("ts", "ord"), name: str = "age") -> DataFrame:
    """The ``keep`` most recent events per user; ``age`` 1 is the last one."""
    newest_first = [F.desc(c) for c in order]
    return skew.top_per_group(ratings, [user], newest_first, keep, name)


def offsets(lengths: DataFrame, *, key: str, length: str = "length") -> DataFrame:
    """Exclusive running sum of the lengths in key order (jagged offsets)."""
    ends = skew.running_totals(lengths, [], [key], {"end_offset": F.col(length)})
    return ends.withColumn("start_offset", F.col("end_offset") - F.col(length))


def to_long(padded: DataFrame, key: str, values: str, length: str, name: str = "value") -> DataFrame:
    """Padded arrays to one row per valid element."""
    valid = F.slice(F.col(values), F.lit(1), F.col(length))
    return padded.select(key, F.posexplode(valid).alias("pos", name))


def to_padded(long: DataFrame, key: str, width: int, fill: Column, *, pos: str = "pos",
              value: str = "value", name: str = "values") -> DataFrame:
    """One row per key: elements by position, cut at ``width`` and padded."""
    # the cut comes before the collection, which is thereby bounded
    parts = long.filter(F.col(pos) < width).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(pos, value))).alias("_parts"))
    return parts.select(key, arrays.pad_right(F.col("_parts")[value], width, fill).alias(name))


def repeat_rows(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def select_rows(df: DataFrame, wanted: DataFrame, key: str, *,
                hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Rows of ``df`` (unique on ``key``) for each listed key, repeats included."""
    return skew.spread_join(wanted, df, [key], "inner", hot_rows=hot_rows)


def next_item_pairs(ratings: DataFrame, *, user: str = "user_id",
                    order: Sequence[str] = ("ts", "ord")) -> DataFrame:
    """Supervision pairs over whole histories: the event at pos predicts pos + 1.

    Each event looks one row ahead within its range of the order, and across
    the edge of a range where one cuts its user. The last event has no pair.
    """
    paired = skew.number_and_next(ratings, [user], order, "pos", ["item_id", "rating"])
    return paired.filter(F.col("next_item_id").isNotNull()).select(
        user, "pos", "item_id", "next_item_id", "next_rating")
