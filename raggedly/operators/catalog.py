"""File counts, class totals, coverage and dataset summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import ClassList
from ..sources.footers import existing_folders, file_states, footer_stats, rows_per_file
from .prefix import bounded

__all__ = ["rows_per_file"]

SPLITS = ("train", "val", "test")


def file_table(df: DataFrame, folder: str = "class_folder", file: str = "file") -> DataFrame:
    """(class_folder, file, n_rows) of events that already carry their file."""
    return df.groupBy(F.col(folder).alias("class_folder"), F.col(file).alias("file")).agg(
        F.count("*").alias("n_rows")
    )


def build_catalog(spark: SparkSession, base_dir: str, classes: ClassList) -> DataFrame:
    """(class_folder, file, n_rows, status) over all class folders that exist.

    Unreadable files are kept out of the counts but not lost: every listed file has
    a row, with status ``ok``, ``empty`` or ``unreadable`` and its error. Counts and states
    come from footers, through Spark's own readers.
    """
    paths = existing_folders(spark, base_dir, classes.class_folders)
    if not paths:
        raise FileNotFoundError(f"no class folder under {base_dir}")
    return file_states(spark, paths).select("class_folder", "file", "n_rows", "status", "error")


def class_stats(
    spark: SparkSession,
    base_dir: str,
    classes: ClassList,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """``class_folder, n_rows`` per class from footers, and the range of each column of ``schema``."""
    stats = footer_stats(spark, base_dir, classes.class_folders, schema)
    return stats.withColumnRenamed("folder", "class_folder")


def class_totals(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("class_folder").agg(F.sum("n_rows").alias("n_rows"))


def dataset_summary(
    manifest: DataFrame, catalog: DataFrame, n_classes: int | None = None
) -> DataFrame:
    """Rows, files and missing files per (class, split), per class and in total.

    Classes that the catalogue does not know at all are left out; a single file it
    does not know counts as missing. Totals are told apart by ``level``
    (0 split, 1 class, 3 all). ``n_classes`` is the number of declared classes, if
    known.
    """
    known = catalog.select("class_folder").distinct()
    counts = catalog.select("class_folder", "file", "n_rows")
    rows = (
        manifest.select("class_folder", "split", "file")
        .join(bounded(known, n_classes), "class_folder", "left_semi")
        .join(counts, ["class_folder", "file"], "left")
        .select("class_folder", "split", "file", "n_rows")
    )
    return rows.rollup("class_folder", "split").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.count("file").alias("n_files"),
        F.count_if(F.col("n_rows").isNull() & F.col("file").isNotNull()).alias("n_missing"),
        F.grouping_id().alias("level"),
    )


def unknown_classes(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Classes of a manifest that the catalogue does not list."""
    return (
        manifest.select("class_folder")
        .distinct()
        .join(catalog.select("class_folder").distinct(), "class_folder", "left_anti")
    )


def uncounted(written: DataFrame, catalog: DataFrame) -> DataFrame:
    """Written files that the catalogue does not know; must be empty for a coverage check."""
    return written.join(catalog.select("class_folder", "file"), ["class_folder", "file"], "left_anti")


def coverage(
    written: DataFrame,
    catalog: DataFrame,
    targets: Mapping[str, int],
    class_folders: Sequence[str],
    strict: bool = True,
) -> DataFrame:
    """(split, class_folder, n_rows, needed, enough) for every declared pair.

    ``strict`` fails on a written file without a count.
    """
    spark = written.sparkSession
    grid = spark.createDataFrame(
        [(s, c, int(n)) for s, n in targets.items() for c in class_folders],
        "split string, class_folder string, needed long",
    )
    counted = written.select("split", "class_folder", "file").join(
        catalog.select("class_folder", "file", "n_rows"), ["class_folder", "file"], "left"
    )
    rows = F.col("n_rows")
    if strict:
        rows = F.coalesce(
            rows, F.raise_error(F.concat(F.lit("no count for "), "class_folder", F.lit("/"), "file"))
        )
    found = counted.groupBy("split", "class_folder").agg(F.sum(rows).alias("n_rows"))
    return grid.join(found, ["split", "class_folder"], "left").select(
        "split",
        "class_folder",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "needed",
        (F.col("n_rows").isNotNull() & (F.col("n_rows") >= F.col("needed"))).alias("enough"),
    )


def has_enough(coverage_rows: DataFrame) -> DataFrame:
    """One row: whether every pair is covered."""
    return coverage_rows.agg(F.bool_and("enough").alias("enough"), F.count("*").alias("pairs"))
