"""What the corpus operators share: defined inputs, the shared folder, Arrow slices."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder, stored

__all__ = ["NO_ID", "SPACE", "corpus", "given_id", "shuffle_partitions", "fresh_folder", "stored"]

#: White space of the contracts, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]"
#: A null id takes the place of the largest id, so that it has a defined order.
NO_ID = (1 << 63) - 1
#: Text handed to one NumPy step; a longer document makes a step of its own.
STEP_BYTES = 4 << 20


def corpus(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    """``_id`` and ``_text`` without nulls (null id: the largest id; null text: empty), and ``more``.

    Other columns of ``docs`` are left out, so that no name of theirs can clash.
    """
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("_text"),
        *[c.alias(n) for n, c in more.items()],
    )


def given_id(name: str = "_id") -> Column:
    """The id as it was given."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Copies of each row of a small side in a spread join.
SPREAD = 8


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], by: Column, how: str = "inner"
) -> DataFrame:
    """Join on ``keys`` where a key may hold most of ``big``: its rows go to ``SPREAD`` places by
    the hash ``by``, and each row of ``small`` to all of them. Spark broadcasts ``small``
    instead where its size is below the session's threshold."""
    salt = F.pmod(by, F.lit(SPREAD)).cast("int")
    copies = small.select(
        *[small[k].alias(f"_of_{k}") for k in keys],
        *[small[c] for c in small.columns if c not in keys],
        F.explode(F.array(*[F.lit(i) for i in range(SPREAD)])).alias("_copy"),
    )
    on = F.col("_salt") == F.col("_copy")
    for k in keys:
        on &= F.col(k) == F.col(f"_of_{k}")
    out = big.withColumn("_salt", salt).join(copies, on, how)
    return out.drop("_salt", "_copy", *[f"_of_{k}" for k in keys])


def steps(
    batches: Iterable[pa.RecordBatch], text: str = "_text", most: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text, none empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    # The worker goes on to other stages, which need the memory that Arrow keeps.
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in one array, and each text's number of words.

    Words are runs of anything but ASCII white space, as in ``[^\\x20\\x09-\\x0D]+``.
    """
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # leading and trailing white space leaves empty words
        sums = np.concatenate([[0], np.cumsum(full)])
        ends = np.cumsum(counts)
        counts = sums[ends] - sums[ends - counts]
        words = words.filter(pa.array(full))
    return words, counts


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter(
        (digest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)
    )
    return table[coded.indices.to_numpy(zero_copy_only=False)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixing of 64 bits (finalizer of a public-domain generator)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal ``keys`` from batches that are sorted by them.

    Only for groups whose size the caller has bounded.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch[k].to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
        if held:
            changed[0] = any(held[-1][k][-1].as_py() != batch[k][0].as_py() for k in keys)
        edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(edges):
            if changed[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
