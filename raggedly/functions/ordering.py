"""Buckets that follow an ordering, so that a sorted group can be worked on in parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 4  # 65,536 buckets


def shuffle_key(seed: int | str, *parts: Column) -> Column:
    """Reproducible shuffle order: md5 of ``seed/part/part...`` as hex text."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def shuffle_bucket(key: Column, digits: int = HASH_DIGITS) -> Column:
    """Leading hex digits of a shuffle key: uniform, and ordered like the key itself."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def float_bucket(x: Column, pieces: int = 1024) -> Column:
    """Order-preserving bucket of a float or double.

    Each factor of two is cut into ``pieces`` equal parts. A float32 has 2**23
    values per factor of two, so at most 2**23 / pieces distinct float32 values
    share a bucket, whatever the data look like. NaN comes last, as in Spark's sort.
    """
    size = F.abs(x.cast("double"))
    power = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1) * pieces)
    rank = (power + 1100) * pieces + part
    top = F.lit(2200 * pieces).cast("long")  # above the bucket of any finite number
    magnitude = F.when(size == float("inf"), top).otherwise(rank)
    return (
        F.when(F.isnan(x), top + 1)
        .when(x > 0, magnitude)
        .when(x < 0, -magnitude)
        .when(x == 0, F.lit(0).cast("long"))
    )
