"""Tables of training runs: sweeps, histories and their best rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running


def finished(runs: DataFrame, status: str = "FINISHED") -> DataFrame:
    return runs.where(F.col("status") == status)


def name_like(runs: DataFrame, pattern: str, column: str = "run_name") -> DataFrame:
    return runs.where(F.col(column).like(pattern))


def labelled(runs: DataFrame, labels: Mapping[str, str], column: str = "run_name") -> DataFrame:
    """Display label of each run; null if it has none."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return runs.withColumn("label", F.try_element_at(F.create_map(*pairs), F.col(column)))


def pivot_max(
    runs: DataFrame, index: str, columns: str, values: str, known: Sequence | None = None
) -> DataFrame:
    """Best value per (index, column).

    Giving the known column values saves a pass; a value outside them ends the job.
    """
    if known:
        other = F.concat(F.lit(f"{columns} is not declared: "), F.coalesce(F.col(columns).cast("string"), F.lit("null")))
        runs = runs.where(
            F.when(F.col(columns).isin(list(known)), True).otherwise(F.raise_error(other).cast("boolean"))
        )
    return runs.groupBy(index).pivot(columns, list(known) if known else None).agg(F.max(values))


def group_best(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Best value of each group and its rank; the smaller name first among equals."""
    return ranked(runs.groupBy(by).agg(F.max(value).alias(value)), value, [by])


def ranked(rows: DataFrame, value: str, ties: Sequence[str]) -> DataFrame:
    """``rank`` by falling value, then ``ties``; spread over tasks like any running total."""
    out = running(rows.withColumn("_all", F.lit(1)), ["_all"], [-F.col(value), *ties], sums={"rank": F.lit(1)})
    return out.select(*rows.columns, F.col("rank").cast("long").alias("rank"))


def epoch_index(
    history: DataFrame, run: str, order: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Number each run's measurements from zero in time order.

    ``bucket``, which must not decrease along ``order``, saves a look at the data.
    """
    return running(history, [run], order, bucket, sums={"_n": F.lit(1)}).select(
        *history.columns, (F.col("_n") - 1).alias("epoch")
    )


def running_best(
    history: DataFrame, run: str, order: Sequence[str], value: str, bucket: Column | None = None
) -> DataFrame:
    """Best value so far within each run; ``bucket`` as in ``epoch_index``."""
    return running(history, [run], order, bucket, maxima={"best": F.col(value)})


def last_epoch(history: DataFrame, by: str, epoch: Column, keep: Sequence[str]) -> DataFrame:
    """The latest row of each label, as an aggregate that combines before the shuffle."""
    return (
        history.groupBy(by)
        .agg(F.max_by(F.struct(*keep), epoch).alias("_last"))
        .select(by, *[F.col(f"_last.{k}").alias(k) for k in keep])
    )


def best_epoch(history: DataFrame, by: str, value: str, earliest: Column, keep: Sequence[str]) -> DataFrame:
    """The row with the best monitored value per run; the earliest one among equals."""
    return (
        history.groupBy(by)
        .agg(F.min_by(F.struct(*keep), F.struct(-F.col(value), earliest)).alias("_best"))
        .select(by, *[F.col(f"_best.{k}").alias(k) for k in keep])
    )


def trials_by_value(trials: DataFrame, params: Sequence[str], value: str = "value") -> DataFrame:
    """Trials with their ``rank``, the best first; smaller parameters first among equals."""
    return ranked(trials, value, params)


def best_trial(trials: DataFrame, params: Sequence[str], value: str = "value") -> DataFrame:
    """The trial with the best value; the largest parameters among equals."""
    return trials.agg(
        F.max_by(F.struct(*params), F.struct(value, *params)).alias("_best"), F.max(value).alias(value)
    ).select(*[F.col(f"_best.{p}").alias(p) for p in params], value)


def merged_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    """(name, value) of both; the second wins where both have a name."""
    both = first.select("name", "value", F.lit(0).alias("_rank")).unionByName(
        second.select("name", "value", F.lit(1).alias("_rank"))
    )
    return both.groupBy("name").agg(F.max_by("value", "_rank").alias("value"))
