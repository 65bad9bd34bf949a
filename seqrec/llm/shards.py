"""Sharding by proportional stratified interleaving. DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked. A row's
fractional rank, its rank as a part of its source, says where in a perfectly
mixed stream it belongs; sorted by it, every stretch of the stream has the
mixture of the whole: of each source, its part up to one row, and one more for
each other source by which the cuts may shift. The stream is cut into shards whose row counts differ by
one at most.

Both rankings are range sorts: rows are dealt out by ranges of the order,
written once with their place in their range, and the sizes of the ranges
before are added. A source of any size is spread over all tasks.

Defined cases: a null source is a source of its own, and null ids come first;
rows that are equal in source and id are told apart only by their place in the
sort; an empty table gives no rows; with fewer rows than shards some shards
are empty; clashing column names get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqrec.llm.common import column, fresh
from seqrec.session import cut_lineage

SEED = 17
SHARDS = 40
_LOCAL = (1 << 33) - 1


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string")))


def _placed(df: DataFrame, order: list[str], part: str, at: str) -> DataFrame:
    """``df`` in ranges of ``order``: the range and the place within it, written once."""
    local = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL))
    return cut_lineage(df.repartitionByRange(*[column(c) for c in order])
                       .sortWithinPartitions(*[column(c) for c in order])
                       .withColumns({part: F.spark_partition_id(), at: local}))


def interleave(df: DataFrame, doc_id: str = "doc_id", source: str = "source", *,
               shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    All columns travel through both sorts: give it keys, and join the texts to
    the result where they are needed.
    """
    key, part, at, own, fraction, shard, slot = fresh(
        df, "_key", "_part", "_at", "_own", "_fraction", "shard", "slot")
    plain = [column(c) for c in df.columns]

    ranked = _placed(df.withColumn(key, shuffle_key(column(doc_id), seed)), [source, key, doc_id], part, at)
    spans = ranked.groupBy(column(source).alias("s"), column(part).alias("p")).agg(
        F.min(column(at)).alias("lo"), F.count(F.lit(1)).alias("n"))
    within = W.partitionBy("s")
    spans = spans.select(
        "s", "p", (F.coalesce(F.sum("n").over(within.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
                   - F.col("lo")).alias("shift"), F.sum("n").over(within).alias("total"))
    joined = ranked.join(spans, (column(part) == F.col("p")) & column(source).eqNullSafe(F.col("s")))
    rank = column(at) + F.col("shift")
    mixed = joined.select(*plain, column(key), ((2 * rank + 1) / (2 * F.col("total"))).alias(fraction))

    stream = _placed(mixed, [fraction, source, key, doc_id], part, at)
    # one row per range
    ranges = stream.groupBy(column(part).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    whole = W.orderBy("p")
    ranges = ranges.select("p", (F.sum("n").over(whole) - F.col("n")).alias("before"),
                           F.sum("n").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("rows"))
    position = column(at) + F.col("before")
    cut = stream.join(F.broadcast(ranges), column(part) == F.col("p")).select(
        *plain, position.alias(own), "rows").withColumn(shard, F.expr(f"(`{own}` * {shards}) div rows").cast("int"))
    begin = F.expr(f"(`{shard}` * rows + {shards - 1}) div {shards}")
    return cut.select(*plain, column(shard), (column(own) - begin).cast("long").alias(slot))


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and 16 for its frame."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def sharded_texts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", *,
                  shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of the documents with ``shard`` and ``slot``; the texts travel once, to their places.

    Rows that repeat an id get the places of that id in turn.
    """
    named, nth, places, shard, slot = fresh(docs, "_named", "_nth", "_places", "shard", "slot")
    keys = docs.select(column(doc_id).alias("doc_id"), column(source).alias("source"))
    placed = interleave(keys, shards=shards, seed=seed).groupBy(F.col("doc_id").alias(named)).agg(
        F.sort_array(F.collect_list(F.struct("source", "shard", "slot"))).alias(places))
    joined = docs.join(placed, column(doc_id).eqNullSafe(column(named)))
    turn = F.row_number().over(W.partitionBy(column(doc_id)).orderBy(column(source)))
    place = F.get(column(places), column(nth) - 1)
    return joined.withColumn(nth, turn).select(*[column(c) for c in docs.columns], place["shard"].alias(shard),
                                               place["slot"].alias(slot))
