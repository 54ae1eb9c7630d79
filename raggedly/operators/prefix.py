"""Running totals, order statistics and first-N, without giving a whole group to one task.

A plain ``sum() over (partition by g order by x)`` sorts all rows of a hot group in
one task. Here the order is first cut into buckets. Bucket totals are small and are
partially aggregated before the shuffle; the window over them gives each bucket its
starting value; only then are rows ranked, inside their (group, bucket).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import float_bucket

CUTS = 4096
MAX_BROADCAST_ROWS = 500_000  # names and numbers, about 100 MB


def with_sampled_bucket(df: DataFrame, key: Column, cuts: int = CUTS) -> DataFrame:
    """Add ``_bucket``: the place of ``key`` (orderable, unique per row) among cut points.

    The cut points are about ``cuts`` keys picked by hash, so they follow the data's
    own distribution and are the same in every task and every retry. They are a
    scalar subquery of bounded size; a row finds its place by binary search.
    """
    keys = df.select(key.alias("_key"))
    every = keys.agg(F.greatest(F.lit(1), F.floor(F.count("*") / cuts)).alias("every")).scalar()
    points = (
        keys.where(F.pmod(F.xxhash64("_key"), every) == 0)
        .agg(F.sort_array(F.collect_set("_key")).alias("points"))
        .scalar()
    )
    # The search is as deep as there are points, however many the hash has picked.
    depth = F.ceil(F.log2(F.greatest(F.size("_points"), F.lit(1)) + F.lit(1.0))).cast("int")
    steps = F.transform(F.sequence(depth, F.lit(0)), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    # The optimizer folds the two projections into one, so no row carries the points.
    return (
        df.withColumn("_points", points)
        .withColumn(
            "_bucket",
            F.aggregate(
                steps,
                F.lit(0),
                lambda at, step: F.when(
                    F.try_element_at(F.col("_points"), at + step) <= key, at + step
                ).otherwise(at),
            ).cast("long"),
        )
        .drop("_points")
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column | None = None,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums and maxima per ``by`` in ``order``.

    ``bucket`` must not decrease along ``order``; without one, cut points are taken
    from the data. ``order`` must be free of ties within a group. ``totals`` adds the
    whole group's sums as ``<name>_total``.

    Each bucket's starting value enters the bucket as one extra first row, so that no
    join is needed and rows are shuffled once.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    if bucket is None:
        work = with_sampled_bucket(df, F.struct(*by, *order))
    else:
        work = df.withColumn("_bucket", bucket)
    inputs = {f"_in_{n}": c for n, c in {**sums, **maxima}.items()}
    work = work.withColumns({**inputs, "_row": F.lit(1)})
    keys = [*by, "_bucket"]
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        work.groupBy(*keys)
        .agg(
            *[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums],
            *[F.max(f"_in_{n}").alias(f"_in_{n}") for n in maxima],
        )
        .select(
            *keys,
            F.lit(0).alias("_row"),
            *[F.sum(f"_in_{n}").over(before).alias(f"_in_{n}") for n in sums],
            *[F.max(f"_in_{n}").over(before).alias(f"_in_{n}") for n in maxima],
            *[F.sum(f"_in_{n}").over(group).alias(f"_of_{n}") for n in sums if totals],
        )
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy("_row", *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = work.unionByName(starts, allowMissingColumns=True).select(
        *df.columns,
        "_row",
        *[F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0)).alias(n) for n in sums],
        *[F.max(f"_in_{n}").over(inside).alias(n) for n in maxima],
        *[F.max(f"_of_{n}").over(inside).alias(f"{n}_total") for n in sums if totals],
    )
    return ranked.where(F.col("_row") == 1).drop("_row")


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a table whose row count has a known, small bound; else leave it to Spark."""
    return F.broadcast(df) if rows is not None and rows <= MAX_BROADCAST_ROWS else df


def first_n(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    n: int,
    groups: int | None = None,
) -> DataFrame:
    """Exactly the first ``n`` rows of each group (all rows of smaller groups).

    Buckets before the one where the count passes ``n`` are taken whole by a filter;
    only rows of that one bucket per group are shuffled and ranked. ``groups`` is an
    upper bound of the number of groups, where the caller knows one.
    """
    work = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        work.groupBy(*by, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(before))
        .where(F.col("_upto") >= n)
        .groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)])
        .agg(
            F.min(F.struct("_bucket", (n - F.col("_upto") + F.col("_n")).alias("left"))).alias(
                "_edge"
            )
        )
    )
    match = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)],
    )
    placed = work.join(bounded(edge, groups), match, "left")
    whole = placed.where(
        F.col("_edge").isNull() | (F.col("_bucket") < F.col("_edge._bucket"))
    ).select(*df.columns)
    inside = Window.partitionBy(*by).orderBy(*order)
    cut = (
        placed.where(F.col("_bucket") == F.col("_edge._bucket"))
        .withColumn("_rank", F.row_number().over(inside))
        .where(F.col("_rank") <= F.col("_edge.left"))
        .select(*df.columns)
    )
    return whole.unionByName(cut)


COARSE_PIECES = 256


def order_statistics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    lower: Sequence[str] = (),
    pieces: Sequence[int] = (COARSE_PIECES, 1 << 20),
    groups: int | None = None,
    coarse: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles per group by linear interpolation, or the lower rank for ``lower``.

    A coarse histogram finds the buckets that hold the wanted ranks, a finer one is
    then made inside these buckets only, and at last the distinct values of the few
    fine buckets are ranked. Each step combines before it shuffles, and none keeps a
    group's values in one place, unlike an exact ``percentile``. ``groups`` is an
    upper bound of the number of groups, where the caller knows one. NaN and null values
    take no part. ``coarse`` is the coarse histogram (``by``, ``_b``, ``_c``) where it is known.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *by, F.col(value).cast("double").alias("_v")
    )
    limit = None if groups is None else 2 * len(fractions) * groups
    levels = [float_bucket(F.col("_v"), p) for p in pieces] + [F.col("_v")]

    group = Window.partitionBy(*by)
    if coarse is None:
        coarse = rows.groupBy(*by, levels[0].alias("_b")).agg(F.count("*").alias("_c"))
    hist = (
        coarse.withColumn("_n", F.sum("_c").over(group))
        .withColumn("_base", _before(group))
    )
    targets = _holding(hist.withColumn("_t", F.array(*_ranks(fractions, lower))), by)
    for wide, fine in zip(levels, levels[1:]):
        keys = [*by, "_k"]
        match = reduce(
            lambda a, b: a & b,
            [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys],
        )
        near = bounded(
            targets.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_b").alias("__k"), "_base", "_t"),
            limit,
        )
        # ``_base`` and ``_t`` are the same for all rows of a coarse bucket.
        hist = (
            rows.withColumn("_k", wide)
            .join(near, match)
            .groupBy(*keys, fine.alias("_b"))
            .agg(
                F.count("*").alias("_c"), F.first("_base").alias("_base"), F.first("_t").alias("_t")
            )
            .withColumn("_base", F.col("_base") + _before(Window.partitionBy(*keys)))
        )
        targets = _holding(hist, by)
    hit = targets.select(*by, F.col("_b").alias("_v"), F.explode("_t").alias("t"))
    return hit.groupBy(*by).agg(
        *[
            F.sum(F.when(F.col("t.q") == name, F.col("t.w") * F.col("_v"))).alias(name)
            for name in fractions
        ]
    )


def _ranks(fractions: Mapping[str, float], lower: Sequence[str]) -> list[Column]:
    """Wanted zero-based ranks of ``_n`` values with the weight each has in its quantile."""
    out = []
    for name, q in fractions.items():
        place = F.lit(float(q)) * (F.col("_n") - 1)
        below = F.floor(place)
        share = F.lit(0.0) if name in lower else place - below
        for rank, weight in ((below, 1 - share), (below + 1, share)):
            out.append(F.struct(F.lit(name).alias("q"), rank.alias("r"), weight.alias("w")))
    return out


def _before(window) -> Column:
    """Number of values in earlier buckets."""
    earlier = window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_c").over(earlier), F.lit(0))


def _holding(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Buckets that hold a wanted rank, each with the ranks it holds."""
    base, n = F.col("_base"), F.col("_c")
    held = F.filter("_t", lambda t: (t["w"] > 0) & (t["r"] >= base) & (t["r"] < base + n))
    return (
        hist.withColumn("_held", held)
        .where(F.size("_held") > 0)
        .select(*by, "_b", "_base", F.col("_held").alias("_t"))
    )
