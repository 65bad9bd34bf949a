"""Numerically stable score functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    """exp() is only ever taken of a non-positive number."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def bce_with_logits(logit: Column, target: Column, pos_weight: float | None = None) -> Column:
    """-(w*y*log s(x) + (1-y)*log(1-s(x)))."""
    weight = 1.0 if pos_weight is None else float(pos_weight)
    return target * weight * softplus(-logit) + (1.0 - target) * softplus(logit)


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return F.aggregate(
        F.transform(F.arrays_zip(values.alias("v"), F.array_repeat(top, F.size(values)).alias("m")),
                    lambda z: F.exp(z["v"] - z["m"])),
        F.lit(0.0), lambda s, x: s + x, lambda s: F.log(s),
    ) + top


def softmax(values: Column) -> Column:
    return F.transform(
        F.arrays_zip(values.alias("v"),
                     F.array_repeat(log_sum_exp(values), F.size(values)).alias("l")),
        lambda z: F.exp(z["v"] - z["l"]),
    )
