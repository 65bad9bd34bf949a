"""Removal of lines that many documents share. DataFrame functions only.

Texts are split at ``\\n``; a line's key is the line without white space at
both ends and with A-Z lower-cased. Lines with a long enough key are exploded
with their position and a 128-bit hash of the key. Keys that are frequent as
lines are counted again as documents; the lines to drop come back to their
document as positions, and the remaining lines are joined in order. Texts are
never exploded together with the counts, and travel once, to their positions.

Defined cases: null and empty texts are one empty line; rows with a null id
keep all their lines and count for nothing; rows with one id are one document
(the rows that hold its key are counted once, and it keeps its lines if it has
the largest id); equal lines of the keeping document all stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.llm.common import ascii_lower, column, fresh
from seqrec.operators.skew import HOT_ROWS, spread_join
from seqrec.session import cut_lineage

# The white space that does not count.
SPACE = " \t\n\v\f\r"
MIN_LENGTH = 40
MIN_DOCS = 5
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(docs: DataFrame, doc_id: str, text: str, min_length: int) -> DataFrame:
    """Id, hash of the row's text, position and 128-bit key hash of each line that is long enough."""
    split = docs.filter(column(doc_id).isNotNull()).select(
        column(doc_id).alias("doc_id"), F.xxhash64(column(text)).alias("text_hash"),
        F.posexplode(_lines(column(text))).alias("pos", "line"))
    # a key has no more code points than its line has bytes
    keys = split.filter(F.octet_length("line") >= min_length).select(
        "doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return keys.filter(F.char_length("key") >= min_length).select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def lines_to_drop(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                  min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(doc_id, text_hash, pos)`` of every line that goes."""
    keyed = cut_lineage(keyed_lines(docs, doc_id, text, min_length))
    # a key in enough documents is in as many lines: only those need the costlier count
    frequent = cut_lineage(keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows"))
                           .filter(F.col("n_rows") >= min_docs))
    shared = cut_lineage(spread_join(keyed, frequent.select(*KEY), KEY, "left_semi", counts=frequent,
                                     hot_rows=hot_rows))
    spread = shared.select(*KEY, "doc_id").distinct().groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    spread = spread.filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper")
    found = spread_join(shared, spread, KEY, counts=frequent, hot_rows=hot_rows)
    return found.filter(F.col("doc_id") != F.col("keeper")).select("doc_id", "text_hash", "pos")


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                      min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """All columns, the text with its remaining lines, and ``n_lines`` and ``n_dropped``.

    Columns of the input with these two names are kept; the new ones then get
    an underscore more.
    """
    drops = lines_to_drop(docs, doc_id, text, min_length=min_length, min_docs=min_docs, hot_rows=hot_rows)
    lines, own_hash, at_id, at_hash, gone, n_lines, n_dropped = fresh(
        docs, "_lines", "_own_hash", "_at_id", "_at_hash", "_gone", "n_lines", "n_dropped")
    drops = drops.groupBy(F.col("doc_id").alias(at_id), F.col("text_hash").alias(at_hash)).agg(
        F.collect_set("pos").alias(gone))
    # the lines are split before the join, so the lambda below only looks them up
    split = docs.withColumns({lines: _lines(column(text)), own_hash: F.xxhash64(column(text))}).drop(text)
    joined = split.join(drops, (column(doc_id) == column(at_id)) & (column(own_hash) == column(at_hash)), "left")
    every = F.sequence(F.lit(0), F.size(column(lines)) - 1)
    kept = F.when(column(gone).isNull(), column(lines)).otherwise(
        F.transform(F.array_except(every, column(gone)), lambda i: F.get(column(lines), i)))
    out = [F.array_join(kept, "\n").alias(c) if c == text else column(c) for c in docs.columns]
    return joined.select(*out, F.size(column(lines)).cast("long").alias(n_lines),
                         F.coalesce(F.size(column(gone)), F.lit(0)).cast("long").alias(n_dropped))
