"""Incremental ids for arriving interactions.

Every micro-batch appends the keys it saw first (see ``state``). Its ids depend
only on the batches before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seqrec.operators import ids
from seqrec.streaming import state

SCHEMA = "normalized_id long, original_id string, key string"


def read_lookup(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All ids, or those of the batches before a given one."""
    return state.read(spark, root, SCHEMA, before).select(*ids.LOOKUP_COLUMNS)


def assign_batch(batch: DataFrame, batch_id: int, root: str, column: str, order: Sequence[str], *,
                 fold: bool = False) -> None:
    old = read_lookup(batch.sparkSession, root, before=batch_id)
    keys = ids.raw_keys(batch, column, order, fold=fold)
    state.write(ids.new_ids(keys, old), root, batch_id, read_lookup)


def start(stream: DataFrame, column: str, order: Sequence[str], *, root: str, checkpoint: str,
          fold: bool = False) -> StreamingQuery:
    """Process what is available, or restart where an earlier run stopped."""
    return (stream.writeStream
            .foreachBatch(lambda df, i: assign_batch(df, i, root, column, order, fold=fold))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
