"""Run again, only do new files: the resumable jobs as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.preprocess import PreprocessModel
from ..operators.vectorize import label_vectors
from ..plans.spec import ClassList, EventSpec
from ..session import hadoop_path
from ..sources.events import spec_schema, with_file, with_label
from ..sources.footers import PARQUET_GLOB, literal_path
from ..sources.ledger import Ledger, Versions


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None
) -> DataFrame:
    """Event shards as a stream; each file is taken once, also after a failure.

    ``path`` is a folder, or one file of a folder.
    """
    fs, place = hadoop_path(spark, path)
    single = fs.getFileStatus(place).isFile()
    pattern = place.getName() if single else PARQUET_GLOB
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(place.getParent().toString() if single else path)


def stream_events(
    spark: SparkSession,
    base_dir: str,
    classes: ClassList,
    spec: EventSpec,
    manifest: DataFrame | None = None,
    split: str = "train",
    max_files: int | None = None,
) -> DataFrame:
    """Shards of the class folders as a stream, with class_folder, file, row, label and split.

    Splits come from a ``manifest`` (files that it does not use are left out, also for good), or
    all rows get ``split``. Damaged shards end the stream.
    """
    folders = ",".join(literal_path(f) for f in classes.class_folders)
    reader = spark.readStream.schema(spec_schema(spec)).option("pathGlobFilter", PARQUET_GLOB)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    names = [*spec.columns, "class_folder", "file", "row"]
    events = with_label(with_file(reader.parquet(f"{base_dir}/{{{folders}}}")).select(*names), classes)
    if manifest is None:
        return events.withColumn("split", F.lit(split))
    used = manifest.where(F.col("split") != "unused").select("class_folder", "file", "split")
    return events.join(used, ["class_folder", "file"])


def append_available(df: DataFrame, path: str, checkpoint: str, partition_by=()) -> StreamingQuery:
    """Write everything that is new and stop."""
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(path)
    query.awaitTermination()
    return query


def each_batch(df: DataFrame, checkpoint: str, take, mode: str = "append") -> StreamingQuery:
    """Hand everything that is new to ``take(batch, number)`` and stop."""
    query = (
        df.writeStream.foreachBatch(take)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def incremental_vectorize(
    events: DataFrame, spec: EventSpec, ledger: Ledger, checkpoint: str, row_col: str = "row"
) -> StreamingQuery:
    """Vectorize new event files into the ledger's table.

    ``events`` have their class_folder, file, split and label besides the spec's columns. A
    batch goes in under its number, so one that is repeated after a failure adds nothing, and
    one that failed in the middle is not seen. The number belongs to the checkpoint: streams
    with checkpoints of their own need ledgers of their own.
    """

    def take(batch: DataFrame, number: int) -> None:
        ledger.add(f"{number:012d}", label_vectors(batch, spec, row_col))

    return each_batch(events, checkpoint, take)


def incremental_apply(
    vectors: DataFrame, model: PreprocessModel, path: str, checkpoint: str
) -> StreamingQuery:
    """Preprocess new vector files with statistics fitted before."""
    return append_available(model.transform(vectors), path, checkpoint)


def running_class_counts(
    events: DataFrame, by: str, path: str, checkpoint: str
) -> StreamingQuery:
    """Keep rows per class up to date, one row per class: ``Versions(spark, path).current()``.

    Each batch publishes a new version, so readers see the last whole one at any time.
    """
    counts = events.groupBy(by).agg(F.count("*").alias("n_rows"))
    versions = Versions(events.sparkSession, path)

    def publish(batch: DataFrame, number: int) -> None:
        versions.publish(number, batch)

    return each_batch(counts, checkpoint, publish, "complete")
