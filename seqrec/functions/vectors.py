"""Vector functions on ``array<double>`` columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


def as_doubles(vector: Column) -> Column:
    return vector.cast(DOUBLES)


def as_floats(vector: Column) -> Column:
    return vector.cast("array<float>")


def as_matrix(lists: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Vectors as the rows of a matrix; a null, a null entry or another length is an error, not a shift."""
    if len(lists) == 0:
        return np.empty((0, 0))
    lengths = pc.list_value_length(lists)
    flat = lists.flatten()
    if lists.null_count or flat.null_count or pc.min(lengths) != pc.max(lengths):
        raise ValueError("vectors must be present, without null entries, and of one length")
    return np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), kind).reshape(len(lists), -1)


def truncate(vector: Column, dim: int) -> Column:
    return F.slice(vector, 1, dim)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(vector: Column, eps: float = 1e-6) -> Column:
    """Divide by the norm, which is clamped from below at ``eps``."""
    return F.transform(
        F.arrays_zip(vector.alias("x"), F.array_repeat(F.greatest(norm(vector), F.lit(eps)),
                                                       F.size(vector)).alias("n")),
        lambda z: z["x"] / z["n"],
    )


def layer_norm(vector: Column, dim: int, eps: float = 1e-6) -> Column:
    """Keep the first ``dim`` entries; zero mean and unit (population) variance."""
    head = truncate(vector, dim)
    width = F.size(head).cast("double")
    # mean and variance travel in a struct, so that each is computed once
    stats = F.aggregate(
        head,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")),
        lambda a: F.struct((a["s"] / width).alias("mean"),
                           (a["q"] / width - (a["s"] / width) * (a["s"] / width)).alias("var")),
    )
    return F.transform(
        F.arrays_zip(head.alias("x"), F.array_repeat(stats, F.size(head)).alias("m")),
        lambda z: (z["x"] - z["m"]["mean"]) / F.sqrt(F.greatest(z["m"]["var"], F.lit(0.0)) + eps),
    )


def squared_distance(a: Column, b: Column) -> Column:
    """Squared euclidean distance by norm expansion, clamped at 0."""
    expanded = dot(a, a) + dot(b, b) - 2.0 * dot(a, b)
    return F.greatest(expanded, F.lit(0.0))


def weighted_sum(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * weight_a + y * weight_b)


def scale(vector: Column, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def one_hot(index: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)),
                       lambda i: (i == index).cast("double"))
