"""Near copies by SimHash ball hashing for a stated similarity of word shingles.

One long fingerprint and a small ball, as operator 4 has them, do not reach a
Jaccard similarity of 0.8: a seventh of the bits differ there. So every
distinct shingle set has ``PRINTS`` short fingerprints. Each belongs to one
min-hash of the set and holds one bit of each of ``BITS`` more. Two sets of
similarity s agree in the min-hash with chance s and differ in each bit with
chance (1 - s) / 2. Every distinct fingerprint emits all variants within half
the radius; a variant meets at most ``BITS + 1`` fingerprints, by geometry, so
what meets there is kept as one bit for each. At s = 0.8 two fingerprints meet
with chance 0.54, one of eight pairs with chance 0.998, more above it.

What meets is compared and verified by exact Jaccard similarity (``linking``),
and components join the verified links.

Defined cases: null, empty and blank texts are one text; texts with fewer words
than a shingle have all their words as one; texts with equal sets are one, told
by 128 bits; rows with a null id stay and name no component; rows that repeat
the id that stays all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm import linking
from seqrec.llm.common import column, fresh
from seqrec.llm.shingles import Sketch, matrix
from seqrec.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = (4, 5)
PRINTS, BITS = 8, 20
RADIUS = 2


def fingerprints(signatures: np.ndarray) -> np.ndarray:
    """The fingerprints of each signature as numbers: which one, the min-hash, the bits."""
    drawn = signatures.reshape(len(signatures), PRINTS, BITS + 1).astype(np.int64)
    bits = ((drawn[:, :, 1:] & 1) << np.arange(BITS)).sum(axis=2)
    return (np.arange(PRINTS) << (16 + BITS)) | (drawn[:, :, 0] << BITS) | bits


def _prints(sig: Column) -> Column:
    @F.arrow_udf("array<long>")
    def made(signatures: pa.Array) -> pa.Array:
        found = fingerprints(matrix(signatures)) if len(signatures) else np.zeros((0, PRINTS), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * PRINTS), pa.array(found.ravel()))

    return made(sig)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which fingerprints of each pair of signatures meet."""
    one, two = (x.reshape(len(x), PRINTS, BITS + 1) for x in (a, b))
    apart = ((one[:, :, 1:] ^ two[:, :, 1:]) & 1).sum(axis=2)
    return (one[:, :, 0] == two[:, :, 0]) & (apart <= RADIUS)


def _buckets(texts: DataFrame) -> DataFrame:
    """``bucket, part, tid``: the members of every variant that several fingerprints or texts have."""
    held = cut_lineage(texts.select("tid", F.explode(_prints(F.col("sig"))).alias("fp")))
    flips = [0, *(1 << b for b in range(BITS))]
    distinct = cut_lineage(held.groupBy("fp").agg((F.count(F.lit(1)) > 1).alias("several")))
    variants = distinct.select(F.explode(F.array(*[
        F.struct(F.col("fp").bitwiseXOR(F.lit(flip)).alias("variant"), F.lit(1 << i).alias("who"))
        for i, flip in enumerate(flips)])).alias("v")).select("v.*")
    met = variants.groupBy("variant").agg(F.bit_or("who").alias("who")).filter(F.bit_count("who") > 1)
    of_ball = met.select(F.col("variant").alias("bucket"), F.explode(F.filter(F.array(*[
        F.when(F.col("who").bitwiseAND(F.lit(1 << i)) != 0, F.col("variant").bitwiseXOR(F.lit(flip)))
        for i, flip in enumerate(flips)]), lambda x: x.isNotNull())).alias("fp"))
    of_copies = distinct.filter("several").select(F.col("fp").alias("bucket"), "fp")
    buckets = cut_lineage(of_ball.unionByName(of_copies).distinct())
    part = F.shiftright("bucket", 16 + BITS).cast("int")
    return cut_lineage(held.join(buckets, "fp").select("bucket", part.alias("part"), "tid"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, crowd: int = linking.CROWD) -> DataFrame:
    """One row per document: ``doc_id`` and ``component_id``, the smallest id reachable over near copies."""
    rule = linking.Rule(Sketch(SHINGLE_WORDS, PRINTS * (BITS + 1)), *SIMILARITY)
    plain = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    rows = linking.sketched(plain, rule.sketch, "doc_id", "text")
    corpus = linking.Corpus(plain, rows, rule)
    roots = linking.links(corpus, _buckets(corpus.texts), _shared, crowd=crowd)
    return corpus.component_ids(rows.select("doc_id", "k1", "k2"), roots).select("doc_id", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents that stay: the smallest id of each component. Rows without id stay."""
    found = near_copies(docs, doc_id, text)
    (key,) = fresh(docs, "_dropped_id")
    dropped = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(dropped, column(doc_id) == column(key), "left_anti")
