"""Fit and apply expressions of the normalizers.

Every normalizer ends up as ``(x - shift) / scale``, with a flag that keeps zeros
(padding) at zero. That is what lets one expression serve a whole vector.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6  # fixed value, part of the definitions below

PARAMETERS = {
    "standard": ("mean", "std"),
    "robust": ("median", "iqr"),
    "minmax": ("min", "max"),
    "none": (),
}


def check_normalizer(name: str) -> str:
    if name not in PARAMETERS:
        raise ValueError(f"unknown normalizer '{name}'; available: {list(PARAMETERS)}")
    return name


def standard_mean(x: Column) -> Column:
    return F.coalesce(F.avg(F.when(x != 0, x)), F.lit(0.0))


def standard_std(x: Column) -> Column:
    """Sample deviation of the non-zero values; null for a single one, 1 for none."""
    valid = F.when(x != 0, x)
    return F.when(F.count(valid) == 0, F.lit(1.0)).otherwise(F.stddev_samp(valid) + EPSILON)


def robust_median(median: Column) -> Column:
    return F.coalesce(median, F.lit(0.0))


def robust_iqr(q25: Column, q75: Column) -> Column:
    return F.when(q75.isNull(), F.lit(1.0)).otherwise(F.greatest(q75 - q25, F.lit(EPSILON)))


def standard(x: Column, mean: Column, std: Column) -> Column:
    return F.when(x != 0, (x - mean) / std).otherwise(F.lit(0.0))


def robust(x: Column, median: Column, iqr: Column) -> Column:
    return F.when(x != 0, (x - median) / iqr).otherwise(F.lit(0.0))


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Padding zeros are scaled like any other value."""
    return (x - low) / (high - low + EPSILON)


def standardize(x: Column, mean: Column, std: Column) -> Column:
    """Plain form without the zero mask."""
    return (x - mean) / std


@dataclass(frozen=True)
class Affine:
    shift: float
    scale: float
    keep_zero: bool


def affine(kind: str, stats: Mapping[str, float]) -> Affine:
    check_normalizer(kind)
    if kind == "none":
        return Affine(0.0, 1.0, False)
    a, b = (stats[p] for p in PARAMETERS[kind])
    if a is None or b is None:
        return Affine(0.0, float("nan"), True)
    if kind == "minmax":
        return Affine(a, b - a + EPSILON, False)
    return Affine(a, b, True)


def apply_affine(vector: Column, params: list[Affine]) -> Column:
    """Normalize a whole vector. The parameters are literals in compiled expressions."""
    plain = Affine(0.0, 1.0, False)
    if all(p == plain for p in params):
        return vector
    slots = []
    for i, p in enumerate(params):
        x = F.get(vector, F.lit(i))
        y = (x - p.shift) / p.scale
        if p == plain:
            slots.append(x)
        else:
            slots.append(F.when(x != 0, y).otherwise(F.lit(0.0)) if p.keep_zero else y)
    return F.array(*slots)
