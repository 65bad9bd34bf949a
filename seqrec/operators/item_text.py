"""Item metadata to text, and text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.functions import vectors
from seqrec.functions.text import is_blank, normalize_space, strip
from seqrec.session import cut_lineage

# Separators of the text form, and the movie columns in order.
SEPARATOR = " [SEP] "
BRANCH_SEPARATOR = " > "
CATEGORY_SEPARATOR = "; "
MOVIE_COLUMNS = ["title", "releaseDate", "directedBy", "starring", "genres"]


def part(label: str, value: Column) -> Column:
    """"label: value" with white space normalised; null when there is nothing."""
    clean = normalize_space(value)
    return F.when(F.coalesce(clean, F.lit("")) != "", F.concat(F.lit(f"{label}: "), clean))


def category_text(branches: Column) -> Column:
    """Branches (array of array of text) as "a > b; c"; empty parts are left out."""
    joined = F.transform(
        F.coalesce(branches, F.array().cast("array<array<string>>")),
        lambda b: F.array_join(
            F.transform(F.filter(b, lambda s: s.isNotNull() & (s != "")), normalize_space),
            BRANCH_SEPARATOR))
    return F.array_join(F.filter(joined, lambda s: s != ""), CATEGORY_SEPARATOR)


def product_text(products: DataFrame, *, item: str = "item_id") -> DataFrame:
    """``asin: .. [SEP] title: .. [SEP] categories: .. [SEP] description: ..``.

    Needs title, categories (array of array of text) and description; rows
    without an id are dropped.
    """
    key = strip(F.col(item).cast("string"))
    parts = F.concat_ws(
        SEPARATOR, F.concat(F.lit("asin: "), key), part("title", F.col("title")),
        part("categories", category_text(F.col("categories"))),
        part("description", F.col("description")))
    return products.select(key.alias("item_id"), parts.alias("text")) \
                   .filter(F.coalesce(F.col("item_id"), F.lit("")) != "")


def movie_text(movies: DataFrame, *, item: str = "movieId",
               columns: Sequence[str] = MOVIE_COLUMNS) -> DataFrame:
    """``title: .. [SEP] releaseDate: .. [SEP] ...``, or the id when all are empty."""
    key = strip(F.col(item).cast("string"))
    parts = F.concat_ws(SEPARATOR, *[part(c, F.col(c)) for c in columns])
    text = F.coalesce(F.nullif(parts, F.lit("")), F.concat(F.lit("movieId: "), key))
    return movies.select(key.alias("item_id"), text.alias("text")) \
                 .filter(F.coalesce(F.col("item_id"), F.lit("")) != "")


def skip_blank(texts: DataFrame) -> DataFrame:
    return texts.filter(~is_blank(F.col("text")))


def embed(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], *,
          normalize: bool = True, truncate_dim: int | None = None) -> DataFrame:
    """Run any batch encoder (list of texts -> matrix) over the texts.

    The encoder runs on Arrow batches inside the tasks and must be picklable;
    blank texts are skipped, vectors optionally cut and normalised, and stored
    as float.
    """
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                matrix = np.asarray(encoder(batch["text"].tolist()), dtype=np.float64)
                yield pd.DataFrame({"item_id": batch["item_id"], "embedding": list(matrix)})

    encoded = skip_blank(texts).select("item_id", "text").mapInPandas(
        encode, "item_id string, embedding array<double>")
    return finish_vectors(encoded, normalize=normalize, truncate_dim=truncate_dim)


def finish_vectors(df: DataFrame, *, normalize: bool = True,
                   truncate_dim: int | None = None) -> DataFrame:
    vector = F.col("embedding")
    if truncate_dim is not None:
        vector = vectors.truncate(vector, truncate_dim)
    if normalize:
        vector = vectors.l2_normalize(vector, 1e-12)
    return df.withColumn("embedding", vectors.as_floats(vector))


def embed_tfidf(texts: DataFrame, dim: int) -> DataFrame:
    """Default encoder of built-in stages: hashed term weights, unit norm."""
    stages = Pipeline(stages=[
        Tokenizer(inputCol="text", outputCol="_tokens"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit")])
    usable = skip_blank(texts)
    return stages.fit(usable).transform(usable).select(
        F.col("item_id").cast("string").alias("item_id"),
        vector_to_array("_unit", "float32").alias("embedding"))


def embed_hashed(texts: DataFrame, dim: int, *, key: str = "item_id", idf: bool = False) -> DataFrame:
    """Term counts in ``dim`` md5 buckets, unit norm; with ``idf`` times ln((N + 1) / (texts with the bucket + 1)).

    Terms are counted per (text, bucket) with map-side combination, so a text
    of any length is reduced to at most ``dim`` rows before it is put together.
    """
    terms = skip_blank(texts).select(key, F.explode(
        F.split(normalize_space(F.lower("text")), " ")).alias("_term"))
    digest = F.conv(F.substring(F.md5("_term"), 1, 8), 16, 10).cast("long")
    counts = terms.select(key, F.pmod(digest, F.lit(dim)).cast("int").alias("_bucket")) \
                  .groupBy(key, "_bucket").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    if idf:
        counts = cut_lineage(counts)
        size = counts.agg(F.count_distinct(key).alias("n")).scalar()
        # at most ``dim`` rows
        rare = counts.groupBy("_bucket").agg(F.ln((size + 1) / (F.count(F.lit(1)) + 1)).alias("_idf"))
        counts = counts.join(F.broadcast(rare), "_bucket").withColumn("_n", F.col("_n") * F.col("_idf"))
    filled = counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("_bucket", "_n"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return filled.select(key, dense.alias("_dense")).select(
        key, vectors.l2_normalize(F.col("_dense"), 1e-12).alias("embedding"))


def only_new(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose vectors are not there yet (one row per item on both sides)."""
    return texts.join(done.select("item_id").distinct(), "item_id", "left_anti")


