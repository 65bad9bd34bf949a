"""Semantic ids: code tuples of items, their slots, encodings and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.functions import vectors
from seqrec.functions.text import casefold
from seqrec.operators import skew
from seqrec.session import cut_lineage


# Code vectors are part of a model; up to this measured size every task gets them all.
MODEL_BYTES = 64 * 1024 * 1024


def combine_sources(sources: Sequence[tuple[DataFrame, str | None]], *, first_wins: bool = True) -> DataFrame:
    """Put embedding tables (item_id, embedding, ord) together, ids optionally prefixed.

    With ``first_wins`` later duplicates of an id are dropped (inference);
    fitting keeps them. ``source`` and ``ord`` give the input order.
    """
    parts = [
        df.select(F.concat(F.lit(prefix or ""), F.col("item_id").cast("string")).alias("item_id"),
                  F.lit(i).alias("source"), "ord", "embedding")
        for i, (df, prefix) in enumerate(sources)]
    united = parts[0]
    for other in parts[1:]:
        united = united.unionByName(other)
    if not first_wins:
        return united
    # a minimum per id: duplicates are reduced before they are shuffled
    best = united.groupBy("item_id").agg(
        F.min_by(F.struct("source", "ord", "embedding"), F.struct("source", "ord")).alias("_b"))
    return best.select("item_id", "_b.source", "_b.ord", "_b.embedding")


def dedup_slots(coded: DataFrame, order: Sequence[str], *, cardinality: int | None = 256) -> DataFrame:
    """Number the items that share a code tuple, in input order, as ``dedup_slot``.

    Reaching ``cardinality`` fails the job; None accepts any number.
    """
    out = skew.number_rows(coded, ["codes"], order, "dedup_slot")
    if cardinality is None:
        return out
    if cardinality <= 0:
        raise ValueError("cardinality must be positive")
    fail = F.raise_error(F.lit(f"more than {cardinality} items share a code tuple"))
    return out.withColumn("dedup_slot", F.when(F.col("dedup_slot") < cardinality,
                                               F.col("dedup_slot")).otherwise(fail.cast("int")))


def collision_statistics(coded: DataFrame) -> DataFrame:
    """Colliding items and the largest group, from counts per code tuple."""
    groups = skew.key_counts(coded, ["codes"])
    return groups.agg(F.sum("n_rows").alias("items"), F.count(F.lit(1)).alias("distinct_codes"),
                      F.sum(F.col("n_rows") - 1).alias("collisions"),
                      F.max("n_rows").alias("largest_group"))


def join_lookup(coded: DataFrame, lookup: DataFrame, num_items: int | Column, *, shift: int = 1,
                fold: bool = True, numeric_as_is: bool = False) -> DataFrame:
    """Codes by item number (1..num_items), found through the item lookup.

    ``status`` is ok, missing or out_of_range; callers keep the ok rows.
    ``numeric_as_is`` takes numeric original ids as item numbers.
    """
    text = F.col("item_id").cast("string")
    keyed = coded.select("*", (casefold(text) if fold else text).alias("key"))
    # several coded items can fold to one key, but each item has one row
    found = keyed.join(lookup.select("key", F.col("normalized_id").alias("_id")), "key", "left")
    number = F.col("_id") + shift
    if numeric_as_is:
        number = F.coalesce(F.expr("try_cast(trim(cast(item_id AS string)) AS bigint)"), number)
    limit = F.lit(num_items) if isinstance(num_items, int) else num_items
    return found.withColumn("item_number", number.cast("long")).withColumn(
        "status",
        F.when(F.col("item_number").isNull(), "missing")
        .when((F.col("item_number") < 1) | (F.col("item_number") > limit), "out_of_range")
        .otherwise("ok")).drop("_id", "key")


def with_mask(universe: DataFrame, coded: DataFrame, layers: int, *,
              order: Sequence[str] = ("item_id",)) -> DataFrame:
    """Codes for the whole universe with ``has_sid``; items without codes get zeros.

    Of several coded rows with one item number (spellings that fold to one
    key) the last in ``order`` counts.
    """
    known = coded.groupBy(F.col("item_number").alias("item_id")).agg(
        F.max_by("codes", F.struct(*order)).alias("_codes"))
    joined = universe.select("item_id").join(known, "item_id", "left")
    empty = F.array_repeat(F.lit(0), layers)
    return joined.select("item_id", F.coalesce("_codes", empty).alias("codes"),
                         F.col("_codes").isNotNull().alias("has_sid"))


def first_layers(codes: Column, n: int) -> Column:
    return F.slice(codes, 1, n)


def ngram_id(codes: Column, num_codes: int, table_size: int | None = None) -> Column:
    """Code tuple as one number in base ``num_codes``, modulo the table size."""
    value = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a * num_codes + x)
    return value if table_size is None else F.pmod(value, F.lit(table_size))


def prefix_ids(codes: Column, num_codes: int, table_size: int | None = None) -> Column:
    """The ids of all prefixes, shortest first."""
    return F.transform(codes, lambda _, i: ngram_id(F.slice(codes, F.lit(1), i + 1),
                                                    num_codes, table_size))


def layer_ids(codes: Column, num_codes: int) -> Column:
    """Code plus the offset of its layer; the first layer has the largest offset."""
    last = F.size(codes) - 1
    return F.transform(codes, lambda x, i: (x + (last - i) * num_codes).cast("long"))


def sid_vectors(items: DataFrame, ids: Column, table: DataFrame, table_rows: int, dim: int,
                layers: int, *, scaled: bool = True) -> DataFrame:
    """Sum of the table vectors of each item's ids, divided by the root of their number.

    ``table``: (emb_id, vector) with ids in [0, table_rows]; row 0 is padding,
    a zero vector. The table is part of the model. Up to 64 MB it is joined
    layer by layer from a broadcast, without a shuffle; beyond that with a
    balanced join.
    """
    usable = cut_lineage(table.filter(F.col("emb_id").between(1, table_rows))
                         .select("emb_id", F.col("vector").cast(vectors.DOUBLES).alias("vector")))
    fits = usable.count() * dim * 8 <= MODEL_BYTES
    rows = items.withColumns({"_ids": ids, "sid_vector": vectors.zeros(dim)})
    for layer in range(layers):
        keyed = rows.withColumn("emb_id", F.get("_ids", F.lit(layer)))
        # the balanced join reads its input more than once
        joined = (keyed.join(F.broadcast(usable), "emb_id", "left") if fits
                  else skew.spread_join(cut_lineage(keyed), usable, ["emb_id"], "left"))
        rows = joined.withColumn("sid_vector", F.when(F.col("vector").isNull(), F.col("sid_vector"))
                                 .otherwise(F.zip_with("sid_vector", "vector", lambda a, b: a + b))
                                 ).drop("vector", "emb_id")
    if scaled:
        root = float(layers) ** 0.5
        rows = rows.withColumn("sid_vector", F.transform("sid_vector", lambda x: x / root))
    return rows.drop("_ids")


def combine_with_individual(items: DataFrame, *, method: str = "sum", weight: float = 0.5,
                            missing: str = "fallback_to_individual",
                            name: str = "item_vector") -> DataFrame:
    """Semantic plus individual vector; items without codes fall back, or are zero."""
    sid, own = F.col("sid_vector"), F.col("individual_vector")
    if method == "sum":
        both = vectors.weighted_sum(sid, own, 1.0, 1.0)
    elif method == "scalarweight":
        both = vectors.weighted_sum(sid, own, weight, 1.0 - weight)
    else:
        raise ValueError(f"unknown combination {method}")
    if missing == "fallback_to_individual":
        other = own
    elif missing == "zeros_if_missing":
        other = F.transform(own, lambda x: F.lit(0.0))
    else:
        raise ValueError(f"unknown strategy {missing}")
    return items.withColumn(name, F.when(F.col("has_sid"), both).otherwise(other))
