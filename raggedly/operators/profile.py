"""Histograms and distinct values for looking at a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .prefix import bounded


def long_features(df: DataFrame, features: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, value) for a few named columns; nulls are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value"))
            for n, c in features.items()
        ]
    )
    return (
        df.select(*by, F.explode(pairs).alias("f"))
        .select(*by, "f.feature", "f.value")
        .where(F.col("value").isNotNull())
    )


def histogram(
    values: DataFrame, bins: int, by: Sequence[str] = ("feature",), groups: int | None = None
) -> DataFrame:
    """Counts in equal bins between minimum and maximum, the last bin closed.

    A constant feature is widened by a half on each side. Empty bins have no row.
    ``groups`` is an upper bound of the number of histograms, where one is known.
    """
    keys = [f"_{k}" for k in by]
    ranges = values.groupBy(*[F.col(k).alias(a) for k, a in zip(by, keys)]).agg(
        F.min("value").alias("_min"), F.max("value").alias("_max")
    )
    if groups is None:  # one row per histogram: stored and counted, to choose the join
        ranges = stored(ranges, "ranges")
        groups = ranges.count()
    flat = F.col("_min") == F.col("_max")
    ranges = ranges.select(
        *keys,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("low"),
        F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("high"),
    )
    match = None
    for k, a in zip(by, keys):
        same = F.col(k).eqNullSafe(F.col(a))
        match = same if match is None else match & same
    place = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    step = (F.col("high") - F.col("low")) / bins
    return (
        values.join(bounded(ranges, groups), match)
        .groupBy(*by, "low", "high", F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(*by, "bin", (F.col("low") + F.col("bin") * step).alias("left_edge"), "n")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct elements of a list column (or of a plain one)."""
    if df.schema[column].dataType.typeName() == "array":
        df = df.select(F.explode(column).alias(column))
    return df.select(column).distinct()
