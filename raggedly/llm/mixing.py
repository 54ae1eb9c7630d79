"""Mix sources to target weights: random order, prefix sums, exact cuts, epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import NO_ID, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Rows of one piece of a source's random order, on average.
PIECE_ROWS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    totals: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MOST_EPOCHS
) -> DataFrame:
    """``target`` for each row of ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn. Together they get the sum
    of all sizes. A target stops at ``epochs`` times the size; what is above is shared
    again by weight among those below, until none is above. Only three sums a round reach
    the driver. A source without words gets 0.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    # One row per source: a catalogue, not the corpus.
    weighed = stored(
        totals.withColumn("_turn", F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))))
        .withColumn(
            "_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("_turn") + 1)
        )
        .withColumn("_most", F.col("source_size").cast("double") * epochs),
        "weighed",
    )
    level, held = 0.0, -1
    while True:
        full = F.col("_most") <= F.col("_weight") * F.lit(level)
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("_most"))).alias("full"),
            F.sum(F.when(~full, F.col("_weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == held or not row["open"]:
            break
        held, level = row["n"], max(0.0, (row["all"] or 0) - (row["full"] or 0)) / row["open"]
    return weighed.select(
        "source",
        "source_size",
        F.least("_most", F.col("_weight") * F.lit(level)).alias("target"),
    )


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    epochs: int = MOST_EPOCHS,
    seed: int = 17,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """What the mix takes of each row: ``doc_id, source, size, source_size, target, taken``.

    Rows get hash-random keys. A source's order is cut into pieces by the leading bits of
    the key, so that even a source with most of the rows is sorted in many tasks; the sums
    of the pieces give each piece its start, and inside a piece a running sum does. A
    source's whole epochs are taken by every row; the rest of the target is cut in key order
    at exactly that many words, in the middle of a row where it must be. The same rows
    always give the same mix. ``carry``: more columns to hand through, under their aliases.

    A null size counts as 0, a null source is a source, a null id counts as the largest.
    Rows that repeat an id are rows of their own; equal ones are interchangeable. No rows
    give no rows.
    """
    rows = stored(
        docs.select(
            F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("_id"),
            docs[source_col].cast("string").alias("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            *carry,
        ).withColumn("_key", F.xxhash64(F.lit(seed), "_id")),
        "sizes",
    )
    names = rows.columns[3:-1]
    pieces = _pieces(rows.count())
    rows = rows.withColumn("_piece", F.pmod(F.shiftright("_key", 32), F.lit(pieces)))
    sums = rows.groupBy("source", "_piece").agg(F.sum("size").alias("_sum"))
    sums = stored(sums, "piece-sums")
    totals = sums.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(totals, weights, epochs).withColumnRenamed("source", "_source")
    before = (
        Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per piece; it becomes the first row of its piece below, so nothing is joined
    # to the rows of a large source.
    starts = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .select("source", "_piece", "_before", "source_size", "target")
    )
    inside = Window.partitionBy("source", "_piece").orderBy(
        F.col("source_size").isNull(), "_key", "_id", "size", *names
    )
    up_to = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.unionByName(starts, allowMissingColumns=True).select(
        "_id",
        "source",
        "size",
        *names,
        (F.sum(F.coalesce("_before", "size")).over(up_to) - F.col("size")).alias("_before"),
        F.first("source_size").over(up_to).alias("source_size"),
        F.first("target").over(up_to).alias("target"),
    )
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return ranked.where(F.col("_id").isNotNull()).select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
        *names,
    )


def _pieces(n: int) -> int:
    pieces = 1
    while pieces * PIECE_ROWS < n:
        pieces *= 2
    return pieces
