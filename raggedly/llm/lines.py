"""Repeated three-line windows: later occurrences go, merged where they overlap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import corpus, given_id, stored

WINDOW = 3


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_of, _same_text, _at``: the windows of a text that also start earlier in the corpus.

    ``rows`` has ``_id, _text, _md5`` (of the text). An id need not name one text, so both
    say whose windows they are; the id alone is the order. The first start of each hash is a minimum, so a window
    that a third of all documents share sends one row per task. A window is the MD5 of
    its lines, which no line can run over. ``_at`` is an array of starts.
    """
    lines = F.split("_text", "\n")
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("_lines") - (window - 1)),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("_lines", i, window), "\n"))),
    )
    windows = stored(
        rows.select("_id", "_md5", lines.alias("_lines"))
        .where(F.size("_lines") >= window)
        .select("_id", "_md5", F.posexplode(hashes).alias("_at", "_hash")),
        "line-windows",
    )
    firsts = (
        windows.groupBy("_hash")
        .agg(F.min(F.struct("_id", "_at")).alias("_first"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .select(F.col("_hash").alias("_same"), "_first")
    )
    later = F.struct("_id", "_at") > F.col("_first")
    return (
        windows.join(firsts, F.col("_hash") == F.col("_same"))
        .where(later)
        .groupBy(F.col("_id").alias("_of"), F.col("_md5").alias("_same_text"))
        .agg(F.collect_set("_at").alias("_at"))
    )


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    keep: Column | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, kept`` (text), ``carried``.

    Lines are what stands between line feeds, unchanged; the text of ``n`` line feeds has
    ``n + 1``. A line goes when a window of three consecutive lines that covers it has the
    same lines as a window with an earlier start (smaller id, or same id and smaller line
    number). Windows are judged on the input, not on what is left. Kept lines are joined by
    line feeds. Texts of fewer lines than a window have none and stay.

    Null text counts as empty: one empty line, and ``kept`` is empty. A null id counts as
    the largest. Rows that repeat an id (or have none) start at the same places, so of
    windows at one place neither is the earlier one; what is found for one of them goes from
    those with the same text only. No rows give no rows. ``carried`` hands ``keep`` through.
    """
    carried = F.lit(None).cast("string") if keep is None else keep
    rows = corpus(docs, id_col, text_col, carried=carried).withColumn("_md5", F.unhex(F.md5("_text")))
    found = repeated_windows(rows.select("_id", "_text", "_md5"), window)
    its_own = (F.col("_id") == F.col("_of")) & (F.col("_md5") == F.col("_same_text"))
    return (
        rows.join(found, its_own, "left")
        .select("_id", "_text", "carried", "_at")
        .mapInArrow(
            _cutter(window),
            rows.select("_id", "carried").schema.add("n_lines", "long")
            .add("n_removed", "long")
            .add("kept", "string"),
        )
        .select(given_id().alias("doc_id"), "n_lines", "n_removed", "kept", "carried")
    )


def covered(starts: np.ndarray, length: int, window: int) -> np.ndarray:
    """Positions that windows at ``starts`` cover."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, length), -1)
    return np.cumsum(change)[:length] > 0


def _cutter(window: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_removed, kept = [], [], []
            for text, at in zip(batch["_text"].to_pylist(), batch["_at"].to_pylist()):
                lines = text.split("\n")
                gone = 0
                if at:
                    away = covered(np.asarray(at, np.int64), len(lines), window)
                    gone = int(away.sum())
                    text = "\n".join(x for x, a in zip(lines, away.tolist()) if not a)
                n_lines.append(len(lines))
                n_removed.append(gone)
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_id"],
                    batch["carried"],
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["_id", "carried", "n_lines", "n_removed", "kept"],
            )

    return cut
