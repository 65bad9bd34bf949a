"""State of a stream as tables: one folder per micro-batch, and snapshots now and then.

A batch is written under ``root/batches/batch=<id>``. After every
``SNAPSHOT_EVERY``-th batch the state up to it is written under
``root/snapshots/upto=<id>``; a reader takes the last snapshot and the batches
after it, so the work of a batch does not grow with the age of the stream.
Both are replaced when a batch is replayed and depend only on what came
before, so a restart gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.session import read_if_present

SNAPSHOT_EVERY = 8


def read(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of the last snapshot and the batches after it, with the ``batch`` they came from.

    Rows of a snapshot count as of its last batch. ``before`` leaves out that batch and later ones.
    """
    parts, last = [spark.createDataFrame([], f"{schema}, batch long")], -1
    snapshots = read_if_present(spark, f"{root}/snapshots", f"{schema}, upto long")
    if snapshots is not None:
        if before is not None:
            snapshots = snapshots.filter(F.col("upto") < before)
        newest = snapshots.agg(F.max("upto")).first()[0]
        if newest is not None:
            last = newest
            parts.append(snapshots.filter(F.col("upto") == last).withColumnRenamed("upto", "batch"))
    batches = read_if_present(spark, f"{root}/batches", f"{schema}, batch long")
    if batches is not None:
        batches = batches.filter(F.col("batch") > last)
        parts.append(batches if before is None else batches.filter(F.col("batch") < before))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write(rows: DataFrame, root: str, batch_id: int, state: Callable[[SparkSession, str, int], DataFrame]) -> None:
    """Store a batch; ``state(spark, root, before)`` gives what a snapshot holds."""
    rows.write.mode("overwrite").parquet(f"{root}/batches/batch={batch_id}")
    if (batch_id + 1) % SNAPSHOT_EVERY == 0:
        state(rows.sparkSession, root, batch_id + 1).write.mode("overwrite").parquet(f"{root}/snapshots/upto={batch_id}")
