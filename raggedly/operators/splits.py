"""Splitting whole files into train, val and test, and cutting the work into chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import shuffle_bucket, shuffle_key
from ..session import stored
from ..sources.sinks import table_or_none
from .prefix import bounded, running

SPLITS = ("train", "val", "test")


def _ordered_files(files: DataFrame, seed: int) -> DataFrame:
    """Files in seeded order with the running row total of their class."""
    keyed = files.withColumn("_key", shuffle_key(seed, F.col("file")))
    return running(
        keyed, ["class_folder"], ["_key", "file"], shuffle_bucket(F.col("_key")),
        sums={"upto": F.col("n_rows")},
    ).withColumn("_place", F.struct("_key", "file"))


def greedy_split(
    files: DataFrame, targets: Sequence[int], seed: int = 42, n_classes: int | None = None
) -> DataFrame:
    """Give each class's shuffled files to train, then val, then test.

    A split is closed by the file that brings it to its target, so it may overshoot
    by that file; even a target of zero takes one. What is left is ``unused``.
    The closing file of each split is an aggregate (the first place where the
    running total passes the mark), so no class is ever walked by one task.
    ``n_classes`` is the number of declared classes, if known.
    """
    # One row per file; each target looks at it again.
    ordered = stored(_ordered_files(files, seed), "ordered-files")
    marked = ordered
    opened, start = F.lit(True), F.lit(0)
    ends: list[str] = []
    for i, target in enumerate(targets):
        previous = ends[-1] if ends else None
        reached = opened & (F.col("upto") - start >= target)
        end = (
            marked.where(reached)
            .groupBy(F.col("class_folder").alias("_class"))
            .agg(F.min(F.struct("_place", "upto")).alias(f"_end{i}"))
        )
        marked = stored(
            marked.join(
                bounded(end, n_classes), F.col("class_folder") == F.col("_class"), "left"
            ).drop("_class"),
            "marked-files",
        )
        ends.append(f"_end{i}")
        opened = F.col(f"_end{i}").isNotNull() & (F.col("_place") > F.col(f"_end{i}._place"))
        start = F.col(f"_end{i}.upto")
    split = F.lit("unused")
    for name, end in reversed(list(zip(SPLITS, ends))):
        split = F.when(
            F.col(end).isNull() | (F.col("_place") <= F.col(f"{end}._place")), name
        ).otherwise(split)
    return marked.select("class_folder", "file", "n_rows", split.alias("split"))


def ratio_split(files: DataFrame, ratio: float, cap: int) -> DataFrame:
    """Files by name: train while the running total is within ratio * cap, then val.

    A class stops at ``cap`` rows: ``take`` is what the last file still gives.
    """
    n = running(files, ["class_folder"], ["file"], sums={"upto": F.col("n_rows")})
    before = F.col("upto") - F.col("n_rows")
    held = F.least(F.col("upto"), F.lit(cap))
    return n.where(before < cap).select(
        "class_folder",
        "file",
        (held - before).alias("take"),
        F.when(held <= F.lit(ratio * cap), "train").otherwise("val").alias("split"),
    )


def with_empty_splits(manifest: DataFrame, class_folders: Sequence[str]) -> DataFrame:
    """One row per (class, split) with its file count, zero where a split got nothing."""
    grid = manifest.sparkSession.createDataFrame(
        [(c, s) for c in class_folders for s in SPLITS], "class_folder string, split string"
    )
    found = manifest.groupBy("class_folder", "split").agg(
        F.count("file").alias("n_files"), F.sum("n_rows").alias("n_rows")
    )
    return grid.join(found, ["class_folder", "split"], "left").select(
        "class_folder",
        "split",
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def _numbered(files: DataFrame, order: Sequence[str]) -> DataFrame:
    return running(files, [], order, sums={"_position": F.lit(1)})


def job_chunks(files: DataFrame, order: Sequence[str], size: int = 50) -> DataFrame:
    """Number the pending files and cut them into chunks of at most ``size``."""
    return _numbered(files, order).withColumn(
        "chunk", F.floor((F.col("_position") - 1) / size)
    ).drop("_position")


def chunk_manifests(chunks: DataFrame) -> DataFrame:
    """Sub-manifest per chunk; its lists are as short as a chunk is."""
    return chunks.groupBy("chunk", "class_folder", "split").agg(
        F.sort_array(F.collect_list("file")).alias("files")
    )


def worker_ranges(files: DataFrame, order: Sequence[str], workers: int) -> DataFrame:
    """Contiguous ranges of ceil(n / workers) files per worker."""
    n = files.agg(F.count("*").alias("n")).scalar()
    return _numbered(files, order).withColumn(
        "worker", F.floor((F.col("_position") - 1) / F.ceil(n / workers))
    ).drop("_position")


def read_or_create_manifest(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    targets: Sequence[int],
    seed: int = 42,
    n_classes: int | None = None,
) -> DataFrame:
    """The stored manifest if there is one, else a new split, stored first."""
    found = table_or_none(spark, path)
    if found is not None:
        return found
    greedy_split(files, targets, seed, n_classes).write.parquet(path)
    return spark.read.parquet(path)
