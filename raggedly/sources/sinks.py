"""Writing vector tables, predictions and small results; resuming what is unfinished."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VECTOR_SCHEMA = "file string, row long, x array<double>, y long, split string, class_folder string"


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    """One row per event with its label, foldered by split and class.

    Spark's commit protocol publishes files only when the job has succeeded.
    """
    # Each folder gets its rows from a few tasks, a large folder from more.
    df.hint("rebalance", "split", "class_folder").write.mode(mode).partitionBy(
        "split", "class_folder"
    ).parquet(path)


def read_vectors(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    class_folders: Sequence[str] | None = None,
) -> DataFrame:
    """Filters on split and class prune whole folders; folders of batches may lie above them."""
    columns = [f.split()[0] for f in VECTOR_SCHEMA.split(", ")]
    df = spark.read.schema(VECTOR_SCHEMA).parquet(path).select(*columns)
    if split is not None:
        df = df.where(F.col("split") == split)
    if class_folders is not None:
        df = df.where(F.col("class_folder").isin(list(class_folders)))
    return df


def table_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """(class_folder, split, file) that a vector table already holds."""
    done = table_or_none(spark, path, VECTOR_SCHEMA)
    if done is None:
        return spark.createDataFrame([], "class_folder string, split string, file string")
    return done.select("class_folder", "split", "file").distinct()


def pending(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Work still to do: expected files without an output."""
    return expected.join(done, ["class_folder", "split", "file"], "left_anti")


def missing_outputs(
    spark: SparkSession, path: str, class_folders: Sequence[str], splits: Sequence[str]
) -> DataFrame:
    """(split, class_folder) pairs that have no preprocessed rows."""
    grid = spark.createDataFrame(
        [(s, c) for s in splits for c in class_folders], "split string, class_folder string"
    )
    return grid.join(
        written_files(spark, path).select("split", "class_folder").distinct(),
        ["split", "class_folder"],
        "left_anti",
    )


def write_predictions(df: DataFrame, path: str, class_names: Sequence[str] | None = None) -> None:
    """Logits and labels; rows without logits are left out."""
    out = df.where(F.col("logits").isNotNull()).select("logits", F.col("label").cast("long"))
    if class_names is not None:
        out = out.withColumn("class_names", F.lit(list(class_names)))
    out.write.mode("overwrite").parquet(path)


def write_distinct(df: DataFrame, path: str, kind: str = "json") -> None:
    """Sorted distinct values as JSON or CSV."""
    ordered = df.orderBy(*df.columns)
    writer = ordered.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.json(path)
