"""Numeric column expressions: softmax, argmax, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax2(z0, z1) -> list[Column]:
    """Numerically stable 2-class softmax -> (p0, p1)."""
    a, b = F.col(z0) if isinstance(z0, str) else z0, F.col(z1) if isinstance(z1, str) else z1
    m = F.greatest(a, b)
    e0, e1 = F.exp(a - m), F.exp(b - m)
    return [e0 / (e0 + e1), e1 / (e0 + e1)]


def softmax(arr) -> Column:
    """Softmax over an array column (any number of classes)."""
    x = F.col(arr) if isinstance(arr, str) else arr
    m = F.array_max(x)
    ex = F.transform(x, lambda v: F.exp(v - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(ex, lambda v: v / tot)


def argmax2(z0, z1) -> Column:
    """Index of the larger of two scores; ties -> 0."""
    a, b = F.col(z0) if isinstance(z0, str) else z0, F.col(z1) if isinstance(z1, str) else z1
    return F.when(b > a, 1).otherwise(0)
