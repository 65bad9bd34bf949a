"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints within ``radius`` bits have a common point at half the radius
from both. Every distinct fingerprint therefore emits all variants within half
the radius; equal variants meet by one shuffle. A variant is met only by
fingerprints of its ball (65 for half a radius of 1), so these groups are
bounded by geometry, whatever the data: exact copies are one fingerprint
before. Within a group each fingerprint is linked to the smallest one and the
link is verified; components then join the links.

Defined cases: null and empty texts, and texts of white space, have the
fingerprint zero and are linked like any other; texts with fewer words than a
shingle are one shingle; rows with a null id get a fingerprint and a component
but never name one, unless every row of the component is without id (then it is
null); rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqrec.llm import components
from seqrec.llm.common import column, fresh
from seqrec.operators.skew import HOT_ROWS, spread_join
from seqrec.session import cut_lineage

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BLOCK = 1 << 20
_SPACE = b" \t\n\v\f\r"


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in blocks cut at white space."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def _bits(shingles: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a whole text, unsigned: bit set where over half the shingle hashes have it."""
    ones, count, carried = np.zeros(64, np.int64), 0, []
    for block in _word_blocks((text or "").encode("utf-8", "replace").lower()):
        block = carried + block
        if len(block) >= words:
            joined = b" ".join(block)
            ends = np.cumsum([len(w) + 1 for w in block]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            shingles = [joined[s:e] for s, e in zip(starts[:len(block) - words + 1].tolist(), ends[words - 1:].tolist())]
            ones += _bits(shingles)
            count += len(shingles)
        carried = block[len(block) - words + 1:] if len(block) >= words else block
    if not count and carried:
        ones, count = _bits([b" ".join(carried)]), 1
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<u8")[0]) if count else 0


def fingerprints(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of a text column as a bigint with the same 64 bits."""
    @F.arrow_udf("long")
    def sketch(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64)
        return pa.array(values.view(np.int64))

    return sketch(text)


def _masks(within: int, bits: int = 64) -> list[int]:
    """Every 64-bit mask of at most ``within`` set bits, as signed numbers."""
    flips = [sum(1 << b for b in chosen) for n in range(within + 1) for chosen in combinations(range(bits), n)]
    return [f - (1 << 64) if f >= 1 << 63 else f for f in flips]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links ``(a, b)`` between distinct fingerprints ``fp``, enough to connect every near pair.

    In a group of one variant all members are within the radius of each other
    (twice half the radius), so links to its smallest member connect the same
    components as all pairs would. An odd radius has no half.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = F.array(*[F.lit(m) for m in _masks(radius // 2)])
    variants = prints.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("a", F.min("fp").over(W.partitionBy("variant")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) <= radius
    return met.filter((F.col("fp") != F.col("a")) & near).select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                    words: int = SHINGLE_WORDS, radius: int = RADIUS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: id, ``fp`` (bigint) and ``component_id``, the smallest id reachable.

    The texts are read once; from then on a document is an id and 8 bytes,
    written to the shared folder. Documents with equal fingerprints meet by a
    pre-aggregated minimum, and get their component by a join that splits a
    fingerprint shared by very many documents.
    """
    sketched = cut_lineage(docs.select(column(doc_id).alias("doc_id"), fingerprints(column(text), words).alias("fp")))
    prints = cut_lineage(sketched.groupBy("fp").agg(F.min("doc_id").alias("least_id"),
                                                    F.count(F.lit(1)).alias("n_rows")))
    found = components.components(links(prints, radius), "a", "b")
    placed = prints.join(found.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root"))
    placed = cut_lineage(placed)
    named = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n_rows"))
    by_root = spread_join(placed, named.select("root", "component_id"), ["root"],
                          counts=named.select("root", "n_rows"), hot_rows=hot_rows)
    return spread_join(sketched, by_root.select("fp", "component_id"), ["fp"],
                       counts=prints.select("fp", "n_rows"), hot_rows=hot_rows)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
             words: int = SHINGLE_WORDS, radius: int = RADIUS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns of the documents that stay: the smallest id of each component.

    Documents to drop are found without their texts and removed by one anti
    join. Rows without id stay; rows that repeat the id that stays all stay.
    """
    found = near_duplicates(docs, doc_id, text, words=words, radius=radius, hot_rows=hot_rows)
    (key,) = fresh(docs, "_dropped_id")
    dropped = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(dropped, column(doc_id) == column(key), "left_anti")
