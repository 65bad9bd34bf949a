"""Session settings the operators rely on."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Needed where it is neither installed on the executors nor given with
    ``--py-files``.
    """
    context = spark.sparkContext
    if not getattr(context, "_seqrec_shipped", False):
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="seqrec-package-")) / package.name
        context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        context._seqrec_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure intermediate tables go to the folder the cluster names.

    A folder of our own is set in local mode only; a cluster without
    ``spark.checkpoint.dir`` is refused, because a machine-local folder would
    be lost together with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="seqrec-checkpoint-")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Unlike a checkpointed row set, the table keeps column pruning and has a
    known size, by which Spark and the operators choose their joins.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_present(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None if there is no such path; every other failure is one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# Plan nodes that are cheap to repeat.
REPEATABLE = {"Relation", "Project", "Filter", "LocalRelation", "LogicalRDD", "Range"}


def once(df: DataFrame) -> DataFrame:
    """A table that several passes may read.

    Scans with projections and filters are returned as they are. Behind a
    join, an aggregation, a window or Python every pass would repeat that
    work, so the table is written first; its size is exact from then on.
    """
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.sub(r"^[\s:+\-]*", "", line).split(" ")[0] for line in tree.splitlines() if line.strip()}
    return df if nodes <= REPEATABLE else cut_lineage(df)


def plan_bytes(df: DataFrame) -> int:
    """Upper estimate of the size of ``df`` by the optimizer, known before it runs."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def conf_bytes(spark: SparkSession, key: str, default: int) -> int:
    """A size setting such as 10485760b, 10MB or -1, in bytes."""
    text = str(spark.conf.get(key, str(default))).strip().lower()
    match = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", text)
    if match is None:
        return default
    return int(match[1]) * 1024 ** " kmgt".index(match[2] or " ")
