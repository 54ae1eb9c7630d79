"""Finished work as a table of its own, and versions of a table that readers always see."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path
from .sinks import VECTOR_SCHEMA, table_or_none, write_vectors

FILES_SCHEMA = "split string, class_folder string, file string, n_rows long, batch string"
KEYS = ["split", "class_folder", "file"]


class Ledger:
    """A vector table at ``root``, written in batches, and which files each batch has finished.

    A batch's vectors are in a folder of its own; one small Parquet file, written after them,
    says which files they are of. That file's appearance is the commit: before it a batch does
    not exist for readers, and a batch that is written again replaces what a lost job left.
    A batch that is in the ledger adds nothing. Nothing is ever deleted or overwritten that a
    reader may see, and what is finished is known without a look at any vector.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def finished(self) -> DataFrame:
        """``split, class_folder, file, n_rows, batch``, a row per finished file."""
        table = table_or_none(self.spark, f"{self.root}/ledger", FILES_SCHEMA)
        return self.spark.createDataFrame([], FILES_SCHEMA) if table is None else table

    def has(self, batch: str) -> bool:
        return bool(self.finished().where(F.col("batch") == batch).limit(1).collect())

    def pending(self, manifest: DataFrame) -> DataFrame:
        """Rows of a manifest (split, class_folder, file) that no batch has finished."""
        return manifest.join(self.finished().select(*KEYS), KEYS, "left_anti")

    def vectors(self) -> DataFrame:
        """The vectors of all finished batches, with their ``batch``.

        Batch names pass through the driver, so that the folders of others are never opened.
        """
        names = [r["batch"] for r in self.finished().select("batch").distinct().collect()]
        table = table_or_none(self.spark, f"{self.root}/vectors", f"{VECTOR_SCHEMA}, batch string")
        if table is None:
            table = self.spark.createDataFrame([], f"{VECTOR_SCHEMA}, batch string")
        return table.where(F.col("batch").isin(names))

    def add(
        self, batch: str, vectors: DataFrame, files: DataFrame | None = None, check=None
    ) -> bool:
        """Write the rows of a batch, then its files; False if the ledger has it already.

        ``files`` are those the batch took on, so that one without rows counts as finished;
        by default the files that gave rows are. ``check()`` is called between the two: if it
        raises, the batch is not there.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"'{batch}' is no name of a folder")
        if self.has(batch):
            return False
        path = f"{self.root}/vectors/batch={batch}"
        write_vectors(vectors, path, mode="overwrite")
        if check is not None:
            check()
        counts = (
            self.spark.read.schema(VECTOR_SCHEMA)
            .parquet(path)
            .groupBy(*KEYS)
            .agg(F.count("*").alias("n_rows"))
        )
        if files is not None:
            counts = files.select(*KEYS).distinct().join(counts, KEYS, "left")
        done = counts.select(*KEYS, F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        # One file: it is there or not, whatever happens to the job that writes it.
        done.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/batch={batch}")
        return True


class Versions:
    """Versions of a small table at ``root``, of which readers see the last published one.

    A version is written whole under its own number, then published by an empty file of that
    number, which appears at once or not at all. A number that is published already is left
    alone. The last ``keep`` published versions stay for readers that have begun.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def published(self) -> list[int]:
        """Numbers in order; a few, as older ones are removed with their versions."""
        fs, place = hadoop_path(self.spark, f"{self.root}/_published")
        if not fs.exists(place):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(place))

    def publish(self, number: int, table: DataFrame) -> bool:
        known = self.published()
        if number in known or known and number < known[0]:
            return False
        table.write.mode("overwrite").parquet(self._folder(number))
        fs, mark = hadoop_path(self.spark, f"{self.root}/_published/{number:020d}")
        fs.create(mark, True).close()
        for old in self.published()[: -self.keep]:
            for path in (f"{self.root}/_published/{old:020d}", self._folder(old)):
                fs, place = hadoop_path(self.spark, path)
                fs.delete(place, True)
        return True

    def current(self) -> DataFrame:
        known = self.published()
        if not known:
            raise FileNotFoundError(f"no published version at {self.root}")
        return self.spark.read.parquet(self._folder(known[-1]))

    def _folder(self, number: int) -> str:
        return f"{self.root}/version={number:020d}"
