"""Kernel decision functions as column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(x: Column, y: list[float]) -> Column:
    """Sum of squared differences of the entries of x and y, as doubles; null where x is null or of another length."""
    other = F.array(*[F.lit(float(v)) for v in y])
    squares = F.zip_with(x.cast("array<double>"), other, lambda a, b: (a - b) * (a - b))
    return F.when(F.size(x) == len(y), F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def rbf_decision(x: Column, support: list[list[float]], weights: list[float], gamma: float, offset: float) -> Column:
    """sum of weight * exp(-gamma * distance²) over the support vectors, less `offset`: one class if it is not negative. The support is a model's, whose size doesn't grow with the rows."""
    score = F.lit(-float(offset))
    for vector, weight in zip(support, weights, strict=True):
        score = score + F.lit(float(weight)) * F.exp(F.lit(-float(gamma)) * squared_distance(x, vector))
    return score
