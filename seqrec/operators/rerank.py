"""Serendipity scores of retrieved pairs, and re-ranking by them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqrec.functions import scores, vectors

Layer = tuple[Sequence[Sequence[float]], Sequence[float]]


def _rows(vectors_of_batch: pa.Array) -> np.ndarray:
    return vectors.as_matrix(vectors_of_batch)


def expert_logits(pairs: DataFrame, layers: Sequence[Layer], *, user_vector: str = "user_vector",
                  item_vector: str = "item_vector", name: str = "ser_logit") -> DataFrame:
    """Logit of a small network on the concatenated user and item vectors.

    ``layers`` are (weights [out][in], bias [out]); ReLU between them, none
    after the last one, which has one output. Vectors may not be null.
    """
    weights = [(np.asarray(w, dtype=np.float64), np.asarray(b, dtype=np.float64))
               for w, b in layers]
    if weights[-1][0].shape[0] != 1:
        raise ValueError("the last layer must have one output")

    @F.arrow_udf("double")
    def forward(users: pa.Array, items: pa.Array) -> pa.Array:
        if len(users) == 0:
            return pa.array([], pa.float64())
        hidden = np.hstack([_rows(users), _rows(items)])
        for w, b in weights[:-1]:
            hidden = np.maximum(hidden @ w.T + b, 0.0)
        w, b = weights[-1]
        return pa.array((hidden @ w.T + b)[:, 0])

    return pairs.withColumn(name, forward(F.col(user_vector), F.col(item_vector)))


def narrowed(users: DataFrame, items: DataFrame, layers: Sequence[Layer], *,
             vector: str = "embedding") -> tuple[DataFrame, DataFrame, list[Layer]]:
    """Users, items and layers of the same network, with the first layer's sums in place of the vectors.

    The first layer is a sum over the user's vector and one over the item's.
    Each is made once per user and per item, so a pair needs as many numbers of
    either as that layer has outputs. Vectors that are shorter than that stay.
    Equal vectors have equal sums.
    """
    weights, bias = (np.asarray(x, dtype=np.float64) for x in layers[0])
    outputs, width = weights.shape
    if 2 * outputs >= width or len(layers) < 2:
        return users, items, list(layers)

    def summed(table: DataFrame, of_user: bool) -> DataFrame:
        @F.arrow_udf("array<double>")
        def sums(column: pa.Array) -> pa.Array:
            known = column.drop_null()
            rows = _rows(known)
            own = weights[:, :rows.shape[1]] if of_user else weights[:, width - rows.shape[1]:]
            # row by row, without a blocked product
            flat = np.einsum("ij,kj->ik", rows, own) if len(known) else np.empty((0, outputs))
            ends = np.concatenate([[0], np.cumsum(column.is_valid().to_numpy(zero_copy_only=False))]) * outputs
            return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.reshape(-1)),
                                            mask=column.is_null() if column.null_count else None)

        return table.withColumn(vector, sums(F.col(vector).cast(vectors.DOUBLES)))

    both = np.hstack([np.eye(outputs), np.eye(outputs)])
    return summed(users, True), summed(items, False), [(both.tolist(), bias.tolist()), *layers[1:]]


def combined_score(base: Column, logit: Column, alpha: float) -> Column:
    """base + alpha * sigmoid(l) * softplus(l)"""
    return base + alpha * scores.sigmoid(logit) * scores.softplus(logit)


def rerank(ranked: DataFrame, alpha: float, *, user: str = "user_id",
           logit: str = "ser_logit") -> DataFrame:
    """Order each user's list (at most k rows) by the combined score.

    The former rank decides ties, as in a stable sort.
    """
    scored = ranked.withColumn("combined_score",
                               combined_score(F.col("score"), F.col(logit), alpha))
    order = W.partitionBy(user).orderBy(F.desc("combined_score"), F.asc("rank"))
    return scored.withColumn("new_rank", F.row_number().over(order)).drop("rank") \
                 .withColumnRenamed("new_rank", "rank")


def rating_logits(users: DataFrame, rating_vectors: Sequence[Sequence[float]], *,
                  vector: str = "embedding", eps: float = 1e-6,
                  name: str = "logits") -> DataFrame:
    """Logits of each user vector against the R rating vectors (all normalised)."""
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rating_vectors])
    unit_rows = F.transform(matrix, lambda r: vectors.l2_normalize(r, eps))
    unit = vectors.l2_normalize(F.col(vector).cast(vectors.DOUBLES), eps)
    # the unit user vector is computed once per row, then used for every rating
    return users.withColumn("_unit", unit).withColumn(
        name, F.transform(unit_rows, lambda r: vectors.dot(F.col("_unit"), r))).drop("_unit")


def fit_classifier(pairs: DataFrame, *, label: str = "ser_label", pos_weight: float = 1.0,
                   max_iter: int = 50, reg: float = 0.0, user_vector: str = "user_vector",
                   item_vector: str = "item_vector") -> LogisticRegressionModel:
    """Distributed logistic regression on the concatenated vectors."""
    prepared = pairs.select(
        array_to_vector(F.concat(user_vector, item_vector)).alias("features"),
        F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)).alias("weight"))
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                              maxIter=max_iter, regParam=reg).fit(prepared)


def classifier_layers(model: LogisticRegressionModel) -> list[Layer]:
    """The fitted model as layers for :func:`expert_logits`."""
    return [([list(map(float, model.coefficients.toArray()))], [float(model.intercept)])]
