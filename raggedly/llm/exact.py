"""Exact duplicates by a tree of merges of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, corpus, given_id, shuffle_partitions, stored

#: Runs that meet in one merge.
FAN = 8


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN
) -> DataFrame:
    """One row per input row: the row that stays of its class of equal texts.

    Texts are equal when they are identical without white space. Of equal texts the row
    with the most code points stays, of these the one with the smallest id. Returns
    ``doc_id, keep_id, group_size, kept, text_sha256``.

    Each of ``fan ** rounds`` runs starts with the rows of a hash of the id. In every
    round the runs exchange parts by one more digit of the digest, ``fan`` runs meet, and
    sorted runs merge: of each digest one row goes on, with the best candidate, the size so
    far and the range of a second hash. After the last round a digest is in one run only.
    A digest therefore reaches a task at most once from each run before it, however many
    rows share it. A digest whose second hashes differ ends the job.

    Null text counts as empty, and empty texts are equal to each other. A null id counts as
    the largest. Rows that repeat an id with the same text all say so (``kept`` holds for
    each, ``group_size`` counts each). No rows give no rows.
    """
    bare = F.regexp_replace("_text", f"{SPACE}+", "")
    rows = stored(
        corpus(docs, id_col, text_col)
        .withColumn("_bare", bare)
        .select(
            "_id",
            F.char_length("_text").alias("_long"),
            F.sha2("_bare", 256).alias("_sha"),
            F.xxhash64("_bare").alias("_check"),
        ),
        "digests",
    )
    levels = rounds(shuffle_partitions(docs.sparkSession), fan)
    best = F.struct((-F.col("_long")).alias("short"), F.col("_id").alias("id"))
    runs = rows.select(
        "_sha",
        F.pmod(F.xxhash64("_id"), F.lit(fan**levels)).alias("_run"),
        best.alias("_best"),
        F.lit(1).cast("long").alias("_n"),
        F.col("_check").alias("_low"),
        F.col("_check").alias("_high"),
    )
    for level in range(levels):
        runs = merge(exchange(runs, level, fan))
    # Every digit of a run's number is now one of the digest's.
    winners = runs.select(
        F.col("_sha").alias("_of"),
        F.col("_best.id").alias("_keep"),
        F.when(F.col("_low") == F.col("_high"), F.col("_n"))
        .otherwise(F.raise_error(F.lit("two texts with one digest")).cast("long"))
        .alias("_n"),
    )
    return rows.join(winners, F.col("_sha") == F.col("_of")).select(
        given_id().alias("doc_id"),
        given_id("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_id") == F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def rounds(partitions: int, fan: int) -> int:
    """Rounds until as many runs as there are partitions have met."""
    n, reach = 1, fan
    while reach < partitions:
        n, reach = n + 1, reach * fan
    return n


def exchange(runs: DataFrame, level: int, fan: int) -> DataFrame:
    """Replace digit ``level`` of the run's number by the same digit of the digest."""
    unit = F.lit(fan**level)
    digit = F.pmod(F.floor(_number("_sha") / unit), F.lit(fan))
    mine = F.pmod(F.floor(F.col("_run") / unit), F.lit(fan))
    return runs.withColumn("_run", F.col("_run") + (digit - mine) * unit)


def merge(runs: DataFrame) -> DataFrame:
    """One row per digest of a run. Structs are merged in sorted order, not by hashing."""
    return runs.groupBy("_run", "_sha").agg(
        F.min("_best").alias("_best"),
        F.sum("_n").alias("_n"),
        F.min("_low").alias("_low"),
        F.max("_high").alias("_high"),
    )


def _number(sha: str) -> Column:
    return F.conv(F.substring(sha, 1, 8), 16, 10).cast("long")
