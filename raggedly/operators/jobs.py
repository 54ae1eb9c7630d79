"""Whole jobs over a manifest that can be stopped and run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import ClassList, EventSpec
from ..session import fresh_folder, stored
from ..sources.events import scan_manifest
from ..sources.ledger import KEYS, Ledger
from .prefix import bounded
from .preprocess import PreprocessModel, seen_by
from .vectorize import label_vectors


def batch_name(files: DataFrame) -> str:
    """A name by the files alone: a job that is run again for the same ones has the same."""
    row = files.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64(*KEYS)).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(1), *KEYS)).alias("b"),
    ).first()
    return f"{row['n']}-{row['a'] & (1 << 64) - 1:016x}{row['b'] & (1 << 64) - 1:016x}"


def vectorize_pending(
    spark: SparkSession,
    base_dir: str,
    manifest: DataFrame,
    classes: ClassList,
    spec: EventSpec,
    ledger: Ledger,
    report: str | None = None,
    row_col: str = "row",
    declared: bool = True,
) -> int:
    """Vectorize the manifest's files that the ledger does not have; their number.

    Only these files are opened, and no vector. Without any left, nothing is read at all. With
    ``report``, missing and damaged shards are written there; they stay pending, so a later run
    takes them when they are mended. ``declared=False`` reads all columns instead of the spec's.
    """
    wanted = manifest.where(
        (F.col("split") != "unused") & F.col("class_folder").isin(classes.class_folders)
    ).select(*KEYS)
    todo = stored(ledger.pending(wanted).distinct(), "pending")
    n = todo.count()
    if not n:
        return 0
    found = fresh_folder(spark, "bad-files") if report is not None else None
    try:
        events = scan_manifest(spark, base_dir, todo, classes, spec if declared else None, found)
    except ValueError:  # no good file among them
        if found is None:
            raise
        events = None
    if found is not None:
        bad = spark.read.schema("split string, class_folder string, file string, n_rows long, "
                                "n_found long, error string").json(found)
        bad.write.mode("overwrite").json(report)
        todo = stored(todo.join(bad.select(*KEYS), KEYS, "left_anti"), "good")
        n = todo.count()
    if events is not None and n:
        ledger.add(batch_name(todo), label_vectors(events, spec, row_col), todo)
    return n


def apply_pending(model: PreprocessModel, source: Ledger, out: Ledger) -> dict:
    """Preprocess the files that ``source`` has finished and ``out`` has not.

    Only the batches that hold such files are read. What is returned is counted by the job that
    writes: ``n_files``, ``n`` rows, ``n_nan`` rows with a NaN, and the sorted list of ``unknown``
    categories. A strict plan fails with that whole list, and then nothing is added.
    """
    done = source.finished().select(*KEYS, "batch")
    todo = stored(out.pending(done), "pending")
    n = todo.count()
    if not n:
        return {"n_files": 0, "n": 0, "n_nan": 0, "unknown": []}
    names = [r["batch"] for r in todo.select("batch").distinct().collect()]
    vectors = source.vectors().where(F.col("batch").isin(names))
    rows = vectors.join(bounded(todo.select(*KEYS, "batch"), n), [*KEYS, "batch"], "left_semi")
    result, look = model.transform_observed(rows.drop("batch"))

    seen = {"n_files": n, "n": 0, "n_nan": 0, "unknown": []}  # as it is without rows

    def check() -> None:
        seen.update(seen_by(look) or {})
        if model.plan.strict and seen["unknown"]:
            raise ValueError(f"values outside the categories: {', '.join(seen['unknown'])}")

    out.add(batch_name(todo), result, todo, check)
    return seen
