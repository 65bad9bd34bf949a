"""From raw documents to training shards: five stages, each on all that the one before kept.

``run`` applies the stages to the table ``documents``; every stage's rows are
written as Parquet in the shared folder and read again as the next one's
input. All stages but the last return the columns of ``documents``.

1. language_id: learn the language profiles from the labelled documents; drop
   texts without a language (null, or without a letter) and texts that share
   next to nothing with any profile.
2. simhash: of each component of near copies (five-word shingles, Jaccard
   similarity of at least 0.8, found by fingerprints and verified exactly) the
   document with the smallest id stays.
3. decontaminate: documents that hold a benchmark item go.
4. mixture: documents are taken up to the budgets of the domain, language and
   source tree, each at most once.
5. shards: every document gets its shard and its place there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.llm import decontaminate, langid, mixing, near_copies, shards
from seqrec.llm import queries as q
from seqrec.llm.common import column, fresh, table
from seqrec.session import cut_lineage, ship_package

MIN_SCORE = 0.2
FRACTION = (3, 4)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus."""
    ship_package(spark)
    lang, score = fresh(docs, "_lang", "_score")
    found = langid.identify(docs, langid.fit(docs), lang_as=lang, score_as=score)
    kept = found.filter((column(lang) != langid.UNDETERMINED) & (column(score) >= MIN_SCORE))
    return kept.select(*[column(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    ship_package(spark)
    return near_copies.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    ship_package(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their domain, language and source."""
    ship_package(spark)
    mixed = mixing.mix(docs, [q.domain(), F.col("lang"), F.col("source")],
                       [q.weight(0, q.DOMAIN_WEIGHTS), q.weight(1, q.LANGUAGE_WEIGHTS), q.weight(2, q.SOURCE_WEIGHTS)],
                       fraction=FRACTION, max_epochs=1)
    return mixed.select(*[column(c) for c in docs.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with the shard and the place of each document."""
    ship_package(spark)
    return shards.sharded_texts(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash", near_duplicates),
    ("decontaminate", benchmark_free),
    ("mixture", mixture),
    ("shards", sharded),
]

#: Profiles, fingerprints and edit distances are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
