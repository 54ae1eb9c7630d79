"""What a fit has seen, as a small table that can be stored, merged and extended."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalizers as N
from ..functions.ordering import float_bucket
from ..session import stored
from .prefix import COARSE_PIECES, _before, _ranks, order_statistics
from .preprocess import FRACTIONS, LOWER, Preprocessor, PreprocessModel

SCHEMA = "block int, bucket long, n long, mean double, m2 double, lo double, hi double"
#: The row that counts vectors, which belong to no block.
VECTORS = -1


class FitState:
    """A histogram per block: values in buckets of a fixed width relative to their size.

    Buckets depend on a value alone, so states of disjoint sets of vectors add up to the state
    of all of them: new files extend a fit without a look at the old ones. Count, least and
    greatest value of a bucket are exact; mean and spread are merged by the usual formula.
    NaN and null values have buckets of their own and take no part in a fit.

    A block has at most some thousand buckets, however many values it has seen.
    """

    def __init__(self, plan: Preprocessor, bins: DataFrame):
        self.plan, self.bins = plan, bins

    @classmethod
    def of(cls, plan: Preprocessor, vectors: DataFrame) -> FitState:
        kinds = sorted({k for k in plan.kinds.values() if k != "none"})
        counted = vectors.agg(F.count("*").alias("n")).select(
            F.lit(VECTORS).alias("block"), F.lit(0).cast("long").alias("bucket"), "n",
            *[F.lit(None).cast("double").alias(c) for c in ("mean", "m2", "lo", "hi")],
        )
        if kinds:
            v = F.col("value")
            bins = (
                plan.block_values(vectors, kinds)
                .select("block", v.cast("double").alias("value"))
                .groupBy("block", float_bucket(v, COARSE_PIECES).alias("bucket"))
                .agg(
                    F.count("*").alias("n"),
                    F.avg("value").alias("mean"),
                    (F.var_pop("value") * F.count("value")).alias("m2"),
                    F.min("value").alias("lo"),
                    F.max("value").alias("hi"),
                )
            )
            counted = bins.unionByName(counted)
        return cls(plan, stored(counted, "fit-state"))

    @classmethod
    def load(cls, spark: SparkSession, plan: Preprocessor, path: str) -> FitState:
        return cls(plan, spark.read.schema(SCHEMA).parquet(path))

    def save(self, path: str) -> None:
        self.bins.coalesce(1).write.parquet(path)

    def merged(self, *others: FitState) -> FitState:
        """The state of all vectors of these states."""
        rows = reduce(DataFrame.unionByName, [s.bins for s in (self, *others)])
        n = F.sum("n")
        mean = F.sum(F.col("n") * F.col("mean")) / n
        between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
        bins = rows.groupBy("block", "bucket").agg(
            n.alias("n"),
            mean.alias("mean"),
            (F.sum("m2") + F.greatest(between, F.lit(0.0))).alias("m2"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
        return FitState(self.plan, stored(bins, "fit-state"))

    def n_vectors(self) -> int:
        return self.bins.where(F.col("block") == VECTORS).agg(F.sum("n")).first()[0] or 0

    def n_left_out(self) -> int:
        """Values that are NaN or null."""
        odd = F.col("bucket").isNull() | F.isnan("mean")
        return self.bins.where((F.col("block") != VECTORS) & odd).agg(F.sum("n")).first()[0] or 0

    def _values(self) -> DataFrame:
        odd = F.col("bucket").isNull() | F.isnan("mean")
        return self.bins.where((F.col("block") != VECTORS) & ~odd)

    def quantile_bounds(self, fractions=FRACTIONS, lower: Sequence[str] = LOWER) -> DataFrame:
        """``block, q, estimate, lo, hi, rank_error`` of the non-zero values.

        The quantile itself is between ``lo`` and ``hi``; no more than ``rank_error`` values of
        the block are between it and the estimate. Ranks inside a bucket are taken as even.
        """
        group = Window.partitionBy("block")
        hist = (
            self._values().where(F.col("bucket") != 0)
            .select("block", F.col("bucket").alias("_b"), F.col("n").alias("_c"), "lo", "hi")
            .withColumn("_n", F.sum("_c").over(group))
            .withColumn("_base", _before(group))
        )
        at = hist.withColumn("t", F.explode(F.array(*_ranks(fractions, lower)))).where(
            (F.col("t.w") > 0) & (F.col("t.r") >= F.col("_base")) & (F.col("t.r") < F.col("_base") + F.col("_c"))
        )
        w = F.col("t.w")
        share = (F.col("t.r") - F.col("_base")) / F.greatest(F.col("_c") - 1, F.lit(1))
        return at.groupBy("block", F.col("t.q").alias("q")).agg(
            F.sum(w * (F.col("lo") + (F.col("hi") - F.col("lo")) * share)).alias("estimate"),
            F.sum(w * F.col("lo")).alias("lo"),
            F.sum(w * F.col("hi")).alias("hi"),
            F.sum("_c").alias("rank_error"),
        )

    def _quantiles(self, exact_from: DataFrame | None) -> DataFrame:
        kinds = {i: self.plan.kinds[b] for i, b in enumerate(self.plan.blocks)}
        robust = [i for i, k in kinds.items() if k == "robust"]
        if exact_from is None:
            return (
                self.quantile_bounds()
                .where(F.col("block").isin(robust))
                .groupBy("block")
                .agg(*[F.max(F.when(F.col("q") == q, F.col("estimate"))).alias(q) for q in FRACTIONS])
            )
        values = self.plan.block_values(exact_from, ["robust"]).where(F.col("value") != 0)
        hist = self._values().where((F.col("bucket") != 0) & F.col("block").isin(robust))
        return order_statistics(
            values, ["block"], "value", FRACTIONS, lower=LOWER, groups=len(self.plan.blocks),
            coarse=hist.select("block", F.col("bucket").alias("_b"), F.col("n").alias("_c")),
        )

    def stats(self, exact_from: DataFrame | None = None) -> DataFrame:
        """One row per block, as ``Preprocessor.fit_stats`` gives it.

        Quantiles are estimates (``quantile_bounds``); with ``exact_from``, the vectors of all
        merged states, they are exact, and only values in the buckets that hold them are ranked.
        """
        spark = self.bins.sparkSession
        declared = spark.createDataFrame(
            [(i, b, self.plan.kinds[b]) for i, b in enumerate(self.plan.blocks)],
            "block int, name string, kind string",
        )
        used = F.col("bucket") != 0
        n = F.sum(F.when(used, F.col("n")))
        values = self._values()
        means = values.groupBy(F.col("block").alias("_of")).agg(
            (F.sum(F.when(used, F.col("n") * F.col("mean"))) / n).alias("_mean")
        )
        off = F.col("mean") - F.col("_mean")
        # One row per declared block on the right.
        moments = (
            values.join(F.broadcast(means), F.col("block") == F.col("_of"))
            .groupBy("block")
            .agg(
                F.coalesce(n, F.lit(0)).alias("_n"),
                F.sum(F.when(used, F.col("m2") + F.col("n") * off * off)).alias("_m2"),
                F.first("_mean").alias("_mean"),
                F.min("lo").alias("min"),
                F.max("hi").alias("max"),
                F.sum("n").alias("n_values"),
            )
        )
        spread = F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1)) + N.EPSILON)
        out = declared.join(
            moments.withColumns(
                {
                    "mean": F.coalesce("_mean", F.lit(0.0)),
                    "std": F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(spread),
                }
            ),
            "block",
            "left",
        )
        if "robust" in self.plan.kinds.values():
            out = out.join(self._quantiles(exact_from), "block", "left")
        else:
            out = out.selectExpr("*", *[f"cast(null as double) {c}" for c in FRACTIONS])
        return self.plan.stats_rows(out)

    def model(self, exact_from: DataFrame | None = None) -> PreprocessModel:
        seen = self.n_vectors()
        if seen == 0:
            raise ValueError("no rows to fit the normalization on")
        rows = self.stats(exact_from).collect()
        stats = {r["block"]: r.asDict() for r in rows}
        return PreprocessModel(self.plan, stats, seen, self.n_left_out())
