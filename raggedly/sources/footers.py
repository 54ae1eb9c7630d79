"""What Parquet footers say, read by Spark itself on any file system that it reads."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import base_name, folder_name, plain_path
from ..session import settings, stored

PARQUET_GLOB = "*.parquet"
#: A file that gives no rows is opened up to this size; an empty one is a footer and no more.
MOST_EMPTY_BYTES, FOOTER_BYTES = 64 << 20, 1 << 20


def literal_path(path: str) -> str:
    """A path in which no character is a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def existing_folders(spark: SparkSession, base_dir: str, folders: Sequence[str]) -> list[str]:
    """Folders that exist, asked of the file system once per declared class."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept = []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(f"{base_dir}/{folder}")
        if path.getFileSystem(conf).exists(path):
            kept.append(f"{base_dir}/{folder}")
    return kept


def listing(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Names and sizes of the Parquet files under ``paths``; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", PARQUET_GLOB)
        .option("recursiveFileLookup", str(recursive).lower())
        .load([paths] if isinstance(paths, str) else list(paths))
        .select(
            folder_name(F.col("path")).alias("class_folder"),
            base_name(F.col("path")).alias("file"),
            "path",
            "length",
        )
    )


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows of each file of a scan. No column is read, so Parquet footers suffice."""
    counts = df.groupBy(F.col("_metadata.file_path").alias("uri")).agg(
        F.count("*").alias("n_rows")
    )
    return counts.select(plain_path(F.col("uri")).alias("path"), "n_rows")


def file_states(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``class_folder, file, path, length, n_rows, status, error`` of the files under ``paths``.

    Rows are counted by footers. A file that gives none is ``empty`` if its footer says so,
    else ``unreadable``; no listed file is lost. A file system that Spark does not reach ends
    the job. The names of files without rows pass through the driver, to be opened.
    """
    # An explicit one-column schema: no footer is opened on the driver to infer one.
    reader = spark.read.option("pathGlobFilter", PARQUET_GLOB).option("ignoreCorruptFiles", "true")
    counts = rows_per_file(reader.schema("_absent int").parquet(*paths)).select(
        folder_name(F.col("path")).alias("class_folder"), base_name(F.col("path")).alias("file"), "n_rows"
    )
    known = stored(listing(spark, paths).join(counts, ["class_folder", "file"], "left"), "listing")
    quiet = [r["path"] for r in known.where(F.col("n_rows").isNull()).select("path").collect()]
    opened = _opened(spark, quiet).withColumnRenamed("path", "_path")
    no_rows = F.col("n_rows").isNull()
    return known.join(opened, F.col("path") == F.col("_path"), "left").select(
        "class_folder",
        "file",
        "path",
        "length",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(~no_rows, "ok").when(F.col("_rows") == 0, "empty").otherwise("unreadable").alias("status"),
        F.when(no_rows & (F.col("_rows") > 0), "the footer counts rows, but none were found")
        .when(no_rows & F.col("_path").isNull(), F.concat(F.lit("no rows in bytes: "), "length"))
        .otherwise(F.col("_error"))
        .alias("error"),
    )


def _opened(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, _rows, _error`` by the footer; one of the two is null."""
    schema = "path string, _rows long, _error string"
    if not paths:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load([literal_path(p) for p in paths])
    tail = F.substring("content", -FOOTER_BYTES, FOOTER_BYTES)
    # Short texts in place of files, so that an Arrow batch stays small.
    return (
        files.where(F.col("length") <= MOST_EMPTY_BYTES)
        .select("path", F.when(F.col("length") > FOOTER_BYTES, tail).otherwise(F.col("content")).alias("tail"))
        .mapInArrow(_parsed, schema)
    )


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, errors = [], []
        for tail in batch["tail"]:
            n = error = None
            try:
                n = pq.ParquetFile(pa.BufferReader(tail.as_buffer())).metadata.num_rows
            except Exception as problem:  # reported with the file
                error = f"{type(problem).__name__}: {problem}"[:500]
            rows.append(n)
            errors.append(error)
        yield pa.RecordBatch.from_arrays(
            [batch["path"], pa.array(rows, pa.int64()), pa.array(errors, pa.string())],
            names=["path", "_rows", "_error"],
        )


def pushed_counts(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """``folder, n_rows``: not evaluated yet.

    Parquet's second-generation reader takes the counts from footers alone, one aggregate for
    each folder; the session must say so while the plan is made and run (``footer_stats`` does).
    """
    out = None
    for folder in folders:
        reader = spark.read.option("pathGlobFilter", PARQUET_GLOB).schema("_absent int")
        part = reader.parquet(literal_path(folder)).agg(F.count("*").alias("n_rows"))
        part = part.select(F.lit(folder.rsplit("/", 1)[-1]).alias("folder"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def footer_stats(
    spark: SparkSession,
    base_dir: str,
    folders: Sequence[str],
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """``folder, n_rows`` of each class folder that exists, by its footers: the plan's scan
    returns the counts and no row is read.

    With a ``schema`` also ``min_c``, ``max_c`` of each of its columns c, by a scan of these
    columns alone. Spark could take them from footers, too, but goes by a column's place there:
    a file with another column in front would give that column's range. A folder without rows
    has null bounds. A damaged footer ends the job; ``file_states`` finds which it is.
    """
    found = existing_folders(spark, base_dir, folders)
    if not found:
        raise FileNotFoundError(f"no class folder under {base_dir}")
    sources = spark.conf.get("spark.sql.sources.useV1SourceList", "")
    rest = ",".join(s for s in sources.split(",") if s and s != "parquet")
    with settings(spark, sources__useV1SourceList=rest, parquet__aggregatePushdown="true"):
        counts = stored(pushed_counts(spark, found), "footer-counts")
    if schema is None:
        return counts
    reader = spark.read.option("pathGlobFilter", PARQUET_GLOB).schema(schema)
    rows = reader.parquet(*[literal_path(f) for f in found])
    ranges = rows.groupBy(
        folder_name(plain_path(F.col("_metadata.file_path"))).alias("folder")
    ).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in rows.columns for f in (F.min, F.max)])
    return counts.join(ranges, "folder", "left")
