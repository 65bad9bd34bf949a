"""Connected components of a graph that never leaves the executors.

The edges are rewritten by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) until
every vertex points to the smallest one of its component. A step needs the
smallest neighbour of each vertex: a pre-aggregated minimum, joined back with
the edges. The minimum is unique per vertex, so Spark's skew join splits the
edges of a vertex that has very many (the centre of a large component). Each
step is written to the shared checkpoint folder, which cuts the lineage and
survives lost executors, and the write itself says whether an edge changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqrec.session import cut_lineage

MAX_ROUNDS = 60


def _least_neighbour(directed: DataFrame) -> DataFrame:
    """Every directed edge (a, b) with m, the smallest of a and its neighbours."""
    least = directed.groupBy("a").agg(F.min("b").alias("least"))
    return directed.join(least, "a").withColumn("m", F.least("a", "least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e"))
    linked = _least_neighbour(both.select("e.a", "e.b")).filter(F.col("b") > F.col("a"))
    return linked.select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _least_neighbour(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return linked.select(F.explode(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("a").alias("u"), F.col("m").alias("v")))).alias("e")
                         ).select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges, written, and what tells them from other edges."""
    seen = Observation()
    written = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"),
                                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")))
    return written, seen.get


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """``(u, root)`` for every vertex that has an edge and is not the smallest of its component.

    Loops, repeated and null-ended edges are ignored. Vertices that are not
    returned are roots.
    """
    edges, seen = _marked(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    for _ in range(MAX_ROUNDS):
        if not seen["n"]:
            return edges.select("u", F.col("v").alias("root"))
        before = seen
        edges, seen = _marked(_small_star(cut_lineage(_large_star(edges))))
        if seen == before:
            return edges.select("u", F.col("v").alias("root"))
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
