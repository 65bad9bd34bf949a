"""Training and evaluation examples with histories of fixed length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.functions import arrays
from seqrec.operators import sequences, skew
from seqrec.session import once


def hash_fraction(*parts: Column) -> Column:
    """Deterministic number in [0, 1) from the md5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_positions(ratings: DataFrame, ratio: float, ignore_last_n: int, seed: int, *,
                     user: str, order: Sequence[str], hot_rows: int) -> DataFrame:
    """Drop the last n events per user, then keep each position with probability ``ratio``."""
    ratings = once(ratings)
    counts = once(skew.key_counts(ratings, [user]))
    placed = sequences.positions(ratings, user=user, order=order)
    sized = skew.spread_join(placed, counts, [user], "inner", counts=counts, hot_rows=hot_rows)
    kept = sized.filter(F.col("pos") < F.col("n_rows") - ignore_last_n)
    return kept.filter(hash_fraction(F.lit(seed), F.col(user), F.col("pos")) < ratio) \
               .drop("pos", "n_rows")


def build(ratings: DataFrame, *, max_length: int = 200, ignore_last_n: int = 0,
          chronological: bool = False, shift: int = 1, sample_ratio: float = 1.0, seed: int = 0,
          int_ratings: bool = False, require_history: bool = False, pad: bool = True,
          user: str = "user_id", order: Sequence[str] = ("ts", "ord"),
          extra: DataFrame | None = None, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """One example per user: the last kept event is the target, the rest the history.

    ``ratings`` needs user, item_id, rating, ts, optionally ser_label, and the
    order columns. Only the ``max_length + 1`` newest kept events of a user
    are ever collected. ``extra`` holds further columns per user.
    """
    labelled = "ser_label" in ratings.columns
    if sample_ratio < 1.0:
        ratings = sample_positions(ratings, sample_ratio, ignore_last_n, seed, user=user,
                                   order=order, hot_rows=hot_rows)
        ignore_last_n = 0
    newest = sequences.recent(ratings, max_length + 1 + ignore_last_n, user=user, order=order)
    newest = newest.filter(F.col("age") > ignore_last_n)
    fields = [(F.col("item_id") + shift).alias("item_id"), F.col("rating").alias("rating"),
              F.col("ts").alias("ts")]
    if labelled:
        fields.append(F.col("ser_label").cast("long").alias("ser_label"))
    per_user = newest.groupBy(user).agg(
        F.array_sort(F.collect_list(F.struct("age", *fields))).alias("_new"))

    target = F.element_at("_new", 1)
    history = F.slice("_new", F.lit(2), F.lit(max_length))  # newest first
    if chronological:
        history = F.reverse(history)
    with_history = per_user.select(user, target.alias("_target"), history.alias("_history"))
    kind = "long" if int_ratings else "double"

    def column(field: str, cast: str) -> Column:
        values = F.transform(F.col("_history")[field], lambda x: x.cast(cast))
        return arrays.pad_right(values, max_length, F.lit(0).cast(cast)) if pad else values

    out = {
        user: F.col(user),
        "historical_ids": column("item_id", "long"),
        "historical_ratings": column("rating", kind),
        "historical_timestamps": column("ts", "long"),
        "history_lengths": F.size("_history"),
        "target_ids": F.col("_target.item_id"),
        "target_ratings": F.col("_target.rating"),
        "target_timestamps": F.col("_target.ts"),
    }
    if labelled:
        out["historical_ser_labels"] = column("ser_label", "long")
    out["target_ser_label"] = F.col("_target.ser_label") if labelled else F.lit(0).cast("long")
    result = with_history.select(*[c.alias(n) for n, c in out.items()])
    if require_history:
        result = result.filter(F.col("history_lengths") > 0)
    return result if extra is None else result.join(extra, user)


def with_output_slots(examples: DataFrame, slots: int, *, put_target: bool = False) -> DataFrame:
    """Append empty output positions and write the target's time after the history.

    With ``put_target`` the target id and rating are written there as well.
    Needs chronological or newest-first padded examples.
    """
    at = F.col("history_lengths")
    rating_type = examples.schema["historical_ratings"].dataType.elementType
    ids = arrays.append_slots(F.col("historical_ids"), slots, F.lit(0).cast("long"))
    ratings = arrays.append_slots(F.col("historical_ratings"), slots, F.lit(0).cast(rating_type))
    times = arrays.append_slots(F.col("historical_timestamps"), slots, F.lit(0).cast("long"))
    if slots > 0:
        times = arrays.put_at(times, at, F.col("target_timestamps"))
        if put_target:
            ids = arrays.put_at(ids, at, F.col("target_ids"))
            ratings = arrays.put_at(ratings, at, F.col("target_ratings").cast(rating_type))
    return examples.withColumns({"historical_ids": ids, "historical_ratings": ratings,
                                 "historical_timestamps": times})


def supervision_pairs(examples: DataFrame, *, user: str = "user_id") -> DataFrame:
    """From chronological examples with the target in place: position i predicts i + 1.

    Weight 0 marks padding, as in the loss; ``pos`` is the predicting position.
    """
    ids = F.col("historical_ids")
    current = F.transform(arrays.drop_last(ids, 1), lambda x, i: F.struct(
        x.alias("item_id"), F.get(ids, i + 1).alias("next_item_id")))
    return examples.select(user, F.posexplode(current).alias("pos", "_pair")).select(
        user, "pos", "_pair.item_id", "_pair.next_item_id",
        (F.col("_pair.next_item_id") != 0).cast("double").alias("weight"))


def interleaved(examples: DataFrame, *, user: str = "user_id") -> DataFrame:
    """Id and rating tokens in turn, with the validity mask and times doubled."""
    ids = F.col("historical_ids")
    ratings = F.transform("historical_ratings", lambda r: r.cast("long"))
    return examples.select(
        user,
        arrays.interleave(ids, ratings).alias("tokens"),
        arrays.duplicate_each(arrays.is_valid(ids)).alias("mask"),
        arrays.duplicate_each(F.col("historical_timestamps")).alias("timestamps"),
        (F.col("history_lengths") * 2).alias("lengths"),
    )


def with_user_token(examples: DataFrame, token_id: Column) -> DataFrame:
    """Put one user-feature token in front and shift by one (rating -1, time 0)."""
    rating_type = examples.schema["historical_ratings"].dataType.elementType
    return examples.withColumns({
        "historical_ids": arrays.prepend_dropping_last(F.col("historical_ids"),
                                                       token_id.cast("long")),
        "historical_ratings": arrays.prepend_dropping_last(F.col("historical_ratings"),
                                                           F.lit(-1).cast(rating_type)),
        "historical_timestamps": arrays.prepend_dropping_last(F.col("historical_timestamps"),
                                                              F.lit(0).cast("long")),
        "history_lengths": F.col("history_lengths") + 1,
    })
