"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that suit both a laptop and a large cluster. Sizes (memory, cores,
# shuffle partitions) are left to spark-submit; AQE coalesces what is too fine.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Methods longer than this are never compiled by the JVM. Above it Spark splits a
    # projection into small methods instead, which wide vectors need.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


_local_folders: dict[str, str] = {}


def local_session(
    app: str = "raggedly", cores: str = "8", memory: str = "8g", shared: str | None = None
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session may fall back to a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="raggedly-")
    return _local_folders[app]


_made: dict[str, list[str]] = {}


def fresh_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/raggedly/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str):
    """``spark.sql`` settings for a while; ``__`` stands for a dot."""
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(names[k], None) for k in values}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(names[k])
            else:
                spark.conf.set(names[k], v)


def hadoop_path(spark: SparkSession, path: str):
    """The file system that Spark itself uses for ``path``, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def clear_folders(spark: SparkSession) -> None:
    """Remove the intermediate results of this session, once its results have been taken."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        fs, place = hadoop_path(spark, path)
        fs.delete(place, True)


def stored(df, name: str):
    """Write an intermediate result to the shared folder and read it back.

    Used where several jobs need the same costly rows; a lost executor then costs a
    re-read, not a re-computation.
    """
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
