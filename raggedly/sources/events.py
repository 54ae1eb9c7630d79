"""Reading event shards and tables this package has written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from ..functions.names import base_name, folder_name, plain_path
from ..plans.spec import ClassList, EventSpec
from .footers import PARQUET_GLOB, existing_folders, file_states, listing, literal_path

__all__ = ["listing"]


def spec_schema(spec: EventSpec) -> T.StructType:
    """Read schema of a declared spec: columns a file has beyond these are never read."""
    fields = []
    for group in spec.groups:
        kind = T.FloatType() if group.topk is None else T.ArrayType(T.FloatType())
        fields += [T.StructField(c, kind) for c in group.columns]
    return T.StructType(fields)


def scan(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    recursive: bool = False,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Projected Parquet scan; other file types and hidden files are left out."""
    reader = (
        spark.read.option("pathGlobFilter", PARQUET_GLOB)
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreCorruptFiles", str(skip_corrupt).lower())
    )
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def with_file(df: DataFrame) -> DataFrame:
    """Add class_folder, file and row (position inside the file) from the scan itself."""
    return df.select(
        "*",
        folder_name(plain_path(F.col("_metadata.file_path"))).alias("class_folder"),
        base_name(plain_path(F.col("_metadata.file_path"))).alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def with_label(df: DataFrame, classes: ClassList, on: str = "class_folder") -> DataFrame:
    """Keep the listed classes and add class_name and label.

    The dimension is the declared class list, so it is as small as the declaration.
    """
    dim = classes.dimension(df.sparkSession).withColumnRenamed("class_folder", on)
    return df.join(F.broadcast(dim), on, "inner")


def _placed(df: DataFrame, classes: ClassList, spec: EventSpec | None) -> DataFrame:
    if spec:
        spec.validate(df.schema)
    kept = [*(spec.columns if spec else df.columns), "class_folder", "file", "row"]
    return with_label(with_file(df).select(*kept), classes)


def scan_classes(
    spark: SparkSession,
    base_dir: str,
    classes: ClassList,
    spec: EventSpec | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """All events of the listed class folders with class, file, row and label.

    With a spec the schema is declared: no file is opened to infer it, and columns beyond
    it are never read.
    """
    paths = [f"{base_dir}/{folder}" for folder in classes.class_folders]
    schema = spec_schema(spec) if spec else None
    return _placed(scan(spark, paths, schema=schema, skip_corrupt=skip_corrupt), classes, spec)


def scan_files(
    spark: SparkSession,
    base_dir: str,
    files: Sequence[tuple[str, str]],
    classes: ClassList,
    spec: EventSpec | None = None,
) -> DataFrame:
    """Events of the named (class_folder, file) pairs; no other file is opened."""
    schema = spec_schema(spec) if spec else None
    return _placed(scan(spark, _paths(base_dir, files), schema=schema), classes, spec)


def _paths(base_dir: str, files: Sequence[tuple[str, str]]) -> list[str]:
    return [f"{base_dir}/{literal_path(c)}/{literal_path(f)}" for c, f in files]


def check_files(
    spark: SparkSession,
    base_dir: str,
    files: DataFrame,
    spec: EventSpec | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The rows of ``files`` (class_folder, file) with ``n_rows, n_found, error``.

    A shard is good as a whole or not at all. First footers say how many rows it has; then its
    declared columns are decoded, and a shard that does not give that many is damaged, also
    when only a few bytes of one column are. Damaged shards are decoded once more, so that
    a failure of the moment condemns none. ``error`` is null for good shards and for empty ones;
    a file that is not there is an error, too. A file system that Spark cannot read ends the
    job, as then nothing is known of any file.

    Decoding reads the declared columns once; without a ``spec`` or ``schema``, all columns.
    """
    files = stored(files.select("class_folder", "file").distinct(), "chosen-files")
    folders = [r["class_folder"] for r in files.select("class_folder").distinct().collect()]
    there = [literal_path(p) for p in existing_folders(spark, base_dir, folders)]
    if there:
        listed = listing(spark, there).select("class_folder", "file", F.lit(True).alias("_there"))
        files = stored(files.join(listed, ["class_folder", "file"], "left"), "listed-files")
    else:
        files = files.withColumn("_there", F.lit(None).cast("boolean"))
    names = [(r["class_folder"], r["file"]) for r in files.where("_there").collect()]
    if not names:
        return files.select(
            "class_folder", "file", *[F.lit(None).cast("long").alias(n) for n in ("n_rows", "n_found")],
            F.lit("no such file").alias("error"),
        )
    states = stored(
        file_states(spark, _paths(base_dir, names)).select("class_folder", "file", "n_rows", "status", "error"),
        "file-states",
    )
    readable = [(r["class_folder"], r["file"]) for r in states.where("status = 'ok'").collect()]
    found = _decoded(spark, base_dir, readable, spec, schema)
    odd = states.join(found, ["class_folder", "file"], "left").where(
        "status = 'ok' AND n_rows <> coalesce(n_found, 0)"
    )
    again = [(r["class_folder"], r["file"]) for r in odd.select("class_folder", "file").collect()]
    if again:
        second = _decoded(spark, base_dir, again, spec, schema or None)
        found = found.join(second.select("class_folder", "file"), ["class_folder", "file"], "left_anti").unionByName(second)
    damaged = F.concat_ws(
        " ", F.lit("the footer counts"), "n_rows", F.lit("rows, but"), F.coalesce("n_found", F.lit(0)), F.lit("can be read")
    )
    return (
        files.join(states, ["class_folder", "file"], "left")
        .join(found, ["class_folder", "file"], "left")
        .select(
            "class_folder",
            "file",
            "n_rows",
            F.coalesce("n_found", F.when(F.col("status").isNotNull(), 0)).cast("long").alias("n_found"),
            F.when(F.col("_there").isNull(), "no such file")
            .when(F.col("status") == "unreadable", F.coalesce("error", F.lit("unreadable")))
            .when(F.col("n_rows") != F.coalesce("n_found", F.lit(0)), damaged)
            .alias("error"),
        )
    )


def _decoded(spark, base_dir, files, spec, schema) -> DataFrame:
    """``class_folder, file, n_found``: rows whose columns can be decoded."""
    if not files:
        return spark.createDataFrame([], "class_folder string, file string, n_found long")
    paths = _paths(base_dir, files)
    schema = schema or (spec_schema(spec) if spec else scan(spark, paths[:1]).schema)
    rows = scan(spark, paths, schema=schema, skip_corrupt=True)
    # Counting the values of a column makes the reader decode it.
    counted = rows.groupBy(F.col("_metadata.file_path").alias("uri")).agg(
        F.count("*").alias("n_found"), *[F.count(F.col(f"`{c}`")).alias(f"_v{i}") for i, c in enumerate(rows.columns)]
    )
    path = plain_path(F.col("uri"))
    whole = stored(counted.select(folder_name(path).alias("class_folder"), base_name(path).alias("file"), "*"), "decoded")
    return whole.select("class_folder", "file", "n_found")


def scan_manifest(
    spark: SparkSession,
    base_dir: str,
    manifest: DataFrame,
    classes: ClassList,
    spec: EventSpec | None = None,
    report: str | None = None,
) -> DataFrame:
    """Events of the manifest's files only, with their split.

    Files are chosen before the read, one scan per split, so no event is joined or
    shuffled. The names pass through the driver, as a scan's file index does anyway.
    With ``report``, files that are missing or damaged anywhere (``check_files``) are left out
    as a whole, and are written there with their error; without it they end the job.
    """
    chosen = manifest.where(
        (F.col("split") != "unused") & F.col("class_folder").isin(classes.class_folders)
    ).select("split", "class_folder", "file")
    if report is not None:
        checked = check_files(spark, base_dir, chosen, spec)
        checked = stored(chosen.join(checked, ["class_folder", "file"]), "checked-files")
        bad = checked.where(F.col("error").isNotNull())
        bad.select("split", "class_folder", "file", "n_rows", "n_found", "error").write.mode(
            "overwrite"
        ).json(report)
        chosen = checked.where(F.col("error").isNull())
    names = chosen.select("split", "class_folder", "file").collect()
    by_split: dict[str, list[tuple[str, str]]] = {}
    for r in names:
        by_split.setdefault(r["split"], []).append((r["class_folder"], r["file"]))
    if not by_split:
        raise ValueError("the manifest names no (good) file of these classes")
    out = None
    for split, files in by_split.items():
        part = scan_files(spark, base_dir, files, classes, spec).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def first_files(files: DataFrame, n: int, by: str = "class_folder") -> DataFrame:
    """The first n files of each folder by name, from a file table."""
    w = Window.partitionBy(by).orderBy("file")
    return files.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
