"""Per-class caps, shuffles and batches of training rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import shuffle_bucket, shuffle_key
from ..plans.spec import ClassList, EventSpec
from ..sources.events import scan_files
from .prefix import bounded, first_n, running


def class_cap(
    df: DataFrame,
    by: str,
    row_id: Sequence[Column],
    cap: int,
    seed: int = 42,
    n_classes: int | None = None,
) -> DataFrame:
    """Exactly ``cap`` rows per class (all of a smaller one), in seeded shuffle order."""
    keyed = df.withColumn("_key", shuffle_key(seed, *row_id))
    return first_n(
        keyed, [by], ["_key"], shuffle_bucket(F.col("_key")), cap, n_classes
    ).drop("_key")


def file_limits(files: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """How many rows each shuffled file gives before its class reaches the cap."""
    keyed = files.withColumn("_key", shuffle_key(seed, F.col("file")))
    placed = running(
        keyed, ["class_folder"], ["_key", "file"], shuffle_bucket(F.col("_key")),
        sums={"upto": F.col("n_rows")},
    )
    left = F.lit(cap) - (F.col("upto") - F.col("n_rows"))
    return placed.where(left > 0).select(
        "class_folder", "file", F.least(left, F.col("n_rows")).alias("take"), "n_rows"
    )


def capped_scan(
    spark: SparkSession,
    base_dir: str,
    classes: ClassList,
    catalog: DataFrame,
    cap: int,
    spec: EventSpec | None = None,
    seed: int = 42,
) -> DataFrame:
    """Per-class cap on a scan of event shards, without ranking or shuffling any row.

    The catalogue says which files are needed, so the others are never opened. The
    cap falls inside at most one file per class; there the scan's own row number
    cuts.
    """
    limits = file_limits(
        catalog.where(F.col("class_folder").isin(classes.class_folders)), cap, seed
    )
    # File names, as many as the scan's own file index holds on the driver anyway.
    rows = limits.collect()
    whole = [(r["class_folder"], r["file"]) for r in rows if r["take"] == r["n_rows"]]
    cut = [(r["class_folder"], r["file"], r["take"]) for r in rows if r["take"] < r["n_rows"]]
    parts = []
    if whole:
        parts.append(scan_files(spark, base_dir, whole, classes, spec))
    if cut:
        ends = spark.createDataFrame(cut, "class_folder string, file string, _take long")
        parts.append(
            scan_files(spark, base_dir, [c[:2] for c in cut], classes, spec)
            .join(bounded(ends, len(cut)), ["class_folder", "file"])
            .where(F.col("row") < F.col("_take"))
            .drop("_take")
        )
    if not parts:
        raise ValueError("the catalogue holds no rows of these classes")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shuffle_positions(df: DataFrame, row_id: Sequence[Column], seed: int = 42) -> DataFrame:
    """Add each row's one-based ``position`` in the shuffle."""
    keyed = df.withColumn("_key", shuffle_key(seed, *row_id))
    return running(
        keyed, [], ["_key"], shuffle_bucket(F.col("_key")), sums={"position": F.lit(1)}
    ).drop("_key")


BUFFER_ROWS = 100_000
MOST_SCANS = 32  # of one file each, in one plan


def buffer_shuffle(
    spark: SparkSession,
    base_dir: str,
    files: DataFrame,
    classes: ClassList,
    workers: int,
    spec: EventSpec | None = None,
    buffer_rows: int = BUFFER_ROWS,
    seed: int = 42,
    files_per_scan: int = 1,
) -> DataFrame:
    """Rows of ``files`` (class_folder, file) with ``worker`` and ``position``: shuffled with
    bounded memory.

    Files stand in seeded order and are dealt to ``workers`` in ranges. A worker is one task: it
    takes its files one after another through a buffer. The first rows fill it; each further row
    takes a slot drawn by a hash of seed, worker and the row's number, and what was there comes
    out. At last the rest comes out in hashed order. A task that runs again draws the same.

    Up to ``MOST_SCANS`` files are read by a scan each, without sorting or moving any row. A plan
    of a scan for each of thousands of files is never done, and one scan reads files in an order
    of its own; so more files are read by one scan, and an exchange with an external sort by file
    and row brings each worker its rows. Rows and positions are the same either way. Without a
    ``spec`` that scan takes the columns of one of the files.

    With several ``files_per_scan`` there is no exchange for any number of files; they stand in
    order of size within a scan. File names pass through the driver, as a scan's file index does
    anyway. Turns off the session's merging of equally partitioned unions, which would make one
    task of all workers.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    named = files.where(F.col("class_folder").isin(classes.class_folders))
    order = shuffle_positions(named.select("class_folder", "file"), [F.col("class_folder"), F.col("file")], seed)
    placed = [(r["class_folder"], r["file"]) for r in sorted(order.collect(), key=lambda r: r["position"])]
    if not placed:
        raise ValueError("no file of these classes")
    share = -(-len(placed) // workers)
    if files_per_scan == 1 and len(placed) > MOST_SCANS:
        out = _by_one_scan(spark, base_dir, placed, share, workers, classes, spec)
    else:
        out = _by_scans(spark, base_dir, placed, share, files_per_scan, classes, spec)
    schema = T.StructType([*out.schema.fields, T.StructField("position", T.LongType())])
    return out.mapInArrow(_through_buffer(buffer_rows, seed), schema)


def _by_scans(spark, base_dir, placed, share, files_per_scan, classes, spec) -> DataFrame:
    """A task per worker that reads its files itself."""
    out = None
    for worker, start in enumerate(range(0, len(placed), share)):
        mine, rows = placed[start : start + share], None
        for i in range(0, len(mine), files_per_scan):
            part = scan_files(spark, base_dir, mine[i : i + files_per_scan], classes, spec)
            rows = part if rows is None else rows.unionByName(part)
        rows = rows.coalesce(1).withColumn("worker", F.lit(worker))
        out = rows if out is None else out.unionByName(rows)
    return out


def _by_one_scan(spark, base_dir, placed, share, workers, classes, spec) -> DataFrame:
    """A task per worker that gets the rows of its files in their order."""
    places = spark.createDataFrame(
        [(c, f, i // share, i) for i, (c, f) in enumerate(placed)],
        "class_folder string, file string, _worker int, _place long",
    )
    rows = scan_files(spark, base_dir, sorted(set(placed)), classes, spec)
    dealt = rows.join(bounded(places, len(placed)), ["class_folder", "file"])
    # By the number itself: by its hash two workers would meet in one task.
    sent = dealt.repartitionById(workers, F.col("_worker"))
    ordered = sent.sortWithinPartitions("_worker", "_place", "row")
    return ordered.select(*rows.columns, "_worker").withColumn("worker", F.col("_worker")).drop("_worker")


def _draw(seed: int, worker: int, what: str) -> int:
    return int(hashlib.md5(f"{seed}/{worker}/{what}".encode()).hexdigest()[:8], 16)


def _through_buffer(size: int, seed: int):
    def through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = None
        for batch in batches:
            workers = batch["worker"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(workers)) + 1).tolist(), batch.num_rows]
            for a, b in pairwise(edges):
                if b == a:
                    continue
                if buffer is None or buffer.worker != workers[a]:
                    if buffer is not None:
                        yield from buffer.rest()
                    buffer = _Buffer(size, seed, int(workers[a]))
                yield from buffer.take(batch.slice(a, b - a))
        if buffer is not None:
            yield from buffer.rest()

    return through


class _Buffer:
    """Slots that say where in the rows held their row is; rows that have left are given up
    when there are as many of them again."""

    def __init__(self, size: int, seed: int, worker: int):
        self.size, self.seed, self.worker = size, seed, worker
        self.held, self.slots, self.seen, self.out = None, np.zeros(0, np.int64), 0, 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first = 0 if self.held is None else self.held.num_rows
        rows = pa.Table.from_batches([batch])
        self.held = rows if self.held is None else pa.concat_tables([self.held, rows])
        places = np.arange(first, first + batch.num_rows)
        filling = min(max(self.size - self.seen, 0), batch.num_rows)
        self.slots = np.concatenate([self.slots, places[:filling]])
        leaving = []
        for t, place in enumerate(places[filling:].tolist(), self.seen + filling):
            slot = _draw(self.seed, self.worker, str(t)) % self.size
            leaving.append(self.slots[slot])
            self.slots[slot] = place
        self.seen += batch.num_rows
        if leaving:
            yield from self._numbered(np.array(leaving))
        if self.held.num_rows > 2 * self.size + batch.num_rows:
            self.held = self.held.take(pa.array(self.slots)).combine_chunks()
            self.slots = np.arange(len(self.slots))

    def rest(self) -> Iterator[pa.RecordBatch]:
        slots = range(len(self.slots))
        order = sorted(slots, key=lambda s: (_draw(self.seed, self.worker, f"end/{s}"), s))
        yield from self._numbered(self.slots[order])

    def _numbered(self, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        numbers = pa.array(np.arange(self.out, self.out + len(places)))
        self.out += len(places)
        rows = self.held.take(pa.array(places)).append_column("position", numbers)
        yield from rows.combine_chunks().to_batches()


def batches(
    df: DataFrame, row_id: Sequence[Column], size: int, seed: int = 42, drop_last: bool = False
) -> DataFrame:
    """Add the number of each row's fixed-size batch."""
    out = shuffle_positions(df, row_id, seed).withColumn(
        "batch", F.floor((F.col("position") - 1) / size)
    )
    if drop_last:
        n = df.agg(F.count("*").alias("n")).scalar()
        out = out.where((F.col("batch") + 1) * size <= n)
    return out.drop("position")
