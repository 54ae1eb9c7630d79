"""Softmax, arg-max and cross-entropy over an array of logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(logits: Column) -> Column:
    return logits.cast("array<double>")


def _exp_sum(z: Column, top: Column) -> Column:
    return F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))


def softmax(logits: Column) -> Column:
    z = _double(logits)
    top = F.array_max(z)
    total = _exp_sum(z, top)
    return F.transform(z, lambda v: F.exp(v - top) / total)


def argmax(values: Column) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label] in the form that does not overflow."""
    z = _double(logits)
    top = F.array_max(z)
    return F.log(_exp_sum(z, top)) + top - F.get(z, label.cast("int"))
