"""Moving estimate of how often each item occurs in a stream.

State per item: the position A of its last occurrence and the smoothed gap B
between occurrences; the estimated probability is 1 / B. A batch contributes
one pre-aggregated row per item, so a frequent item costs no more than a rare
one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqrec.streaming import state as tables

SCHEMA = "item_id long, last_pos long, gap double"


def update(events: DataFrame, state: DataFrame | None, *, alpha: float, cap: float,
           initial_gap: float = 1.0) -> DataFrame:
    """New state of the items in ``events`` (item_id, pos): B = (1-a)B + a(last - A)/n, capped."""
    seen = events.groupBy("item_id").agg(F.max("pos").alias("_last"),
                                         F.count(F.lit(1)).alias("_n"))
    if state is None:
        joined = seen.withColumns({"last_pos": F.lit(0).cast("long"), "gap": F.lit(initial_gap)})
    else:
        joined = seen.join(state, "item_id", "left")  # one row per item on both sides
    before = F.coalesce("last_pos", F.lit(0))
    step = (F.col("_last") - before) / F.col("_n")
    gap = (1.0 - alpha) * F.coalesce("gap", F.lit(initial_gap)) + alpha * step
    return joined.select("item_id", F.col("_last").alias("last_pos"),
                         F.least(gap, F.lit(float(cap))).alias("gap"))


def probability(state: DataFrame) -> DataFrame:
    return state.select("item_id", F.try_divide(F.lit(1.0), F.col("gap")).alias("probability"))


def read_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Latest state per item over all batches, or those before a given one."""
    table = tables.read(spark, root, SCHEMA, before)
    latest = table.groupBy("item_id").agg(F.max_by(F.struct("last_pos", "gap"), "batch").alias("_s"))
    return latest.select("item_id", "_s.last_pos", "_s.gap")


def update_batch(batch: DataFrame, batch_id: int, root: str, *, alpha: float, cap: float,
                 initial_gap: float = 1.0) -> None:
    """Write the changed items of one batch; a replay replaces its folder."""
    state = read_state(batch.sparkSession, root, before=batch_id)
    tables.write(update(batch, state, alpha=alpha, cap=cap, initial_gap=initial_gap), root, batch_id, read_state)


def start(stream: DataFrame, *, root: str, checkpoint: str, alpha: float, cap: float,
          initial_gap: float = 1.0) -> StreamingQuery:
    """``stream``: item_id and its position ``pos`` in the stream, counted from 1."""
    return (stream.writeStream
            .foreachBatch(lambda df, i: update_batch(df, i, root, alpha=alpha, cap=cap,
                                                     initial_gap=initial_gap))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
