"""Near duplicates: MinHash bands find families, full sets confirm every link."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stars import components
from .tables import corpus, given_id, hashed, mix, runs_of, split_words, starts_of, steps, stored

#: Words of a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Minima are grouped into bands. A pair at 80 % misses all of them once in 8 million.
BANDS, ROWS = 40, 5
#: Least share of equal minima between a document and the first one of its bucket.
FAMILY_SHARE = 0.3
#: Rounds in which a bucket's documents are compared with its first one before those that
#: match none are made one family unseen, so that their sets decide.
STAR_ROUNDS = 2
#: Documents of a family that one task compares with as many others.
BLOCK = 512
#: Shingles of one step of hashing, and shared shingles of one product.
STEP_SHINGLES, STEP_COLUMNS = 1 << 16, 4096

SIGNATURES = "_id long, _n long, _s1 long, _s2 long, _bands array<long>, _minima binary"


class Sets(NamedTuple):
    shingles: np.ndarray  # sorted and distinct within a text
    counts: np.ndarray  # of each text


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Sets:
    """Hashes of the distinct ``k``-word shingles of texts, A-Z in lower case.

    A text of fewer words, but some, has its whole sequence as its one shingle.
    """
    words, counts = split_words(pc.ascii_lower(texts))
    names = hashed(words)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(names)) - starts_of(counts)[text]
    size = np.minimum(counts, k)[text]
    heads = np.flatnonzero(place + size <= counts[text])
    value = mix(size[heads].astype(np.uint64), 5)
    with np.errstate(over="ignore"):
        for j in range(k):
            some = np.flatnonzero(j < size[heads])
            value[some] = mix(value[some] * np.uint64(0x9E3779B97F4A7C15) ^ names[heads[some] + j])
    text = text[heads]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return Sets(value[new], np.bincount(text[new], minlength=len(counts)))


def minima(sets: Sets, number: int, seed: int = 11) -> np.ndarray:
    """Minima of ``number`` multiply-add hashes over each set; sets must not be empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, number, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, number, np.uint64) * np.uint64(2)
    out = np.empty((len(sets.counts), number), np.uint64)
    ends = np.cumsum(sets.counts)
    start = 0
    while start < len(ends):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + STEP_SHINGLES, "right")))
        part = sets.shingles[done : int(ends[stop - 1])]
        begins = starts_of(sets.counts[start:stop])
        with np.errstate(over="ignore"):
            for i in range(number):
                out[start:stop, i] = np.minimum.reduceat(part * factors[i] + shifts[i], begins)
        start = stop
    return out


def _sign(k: int, bands: int, rows: int) -> Callable:
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(batch["_text"], k)
            some = np.flatnonzero(sets.counts > 0)
            full = Sets(sets.shingles, sets.counts[some])
            low = minima(full, bands * rows)
            names = np.zeros((len(some), bands), np.uint64)
            for i in range(rows):
                names = mix(names ^ low[:, i::rows], i)
            names = mix(names ^ np.arange(bands, dtype=np.uint64), 77)
            sums = np.zeros((2, len(sets.counts)), np.uint64)
            if len(some):
                begins = starts_of(full.counts)
                for j in range(2):
                    sums[j, some] = np.add.reduceat(mix(full.shingles, 40 + j), begins)
            lists = np.zeros(len(sets.counts) + 1, np.int32)
            lists[1 + some] = bands
            short = (low & np.uint64(255)).astype(np.uint8)
            binary = [None] * len(sets.counts)
            for j, i in enumerate(some.tolist()):
                binary[i] = short[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_id"],
                    pa.array(sets.counts),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(np.cumsum(lists).astype(np.int32)), pa.array(names.ravel().view(np.int64))
                    ),
                    pa.array(binary, pa.binary()),
                ],
                names=["_id", "_n", "_s1", "_s2", "_bands", "_minima"],
            )

    return sign


def families(heads: DataFrame) -> DataFrame:
    """``id, component``: documents that may be similar, by shared bands.

    ``heads`` has one row for each distinct set. Only the first id of a bucket is compared
    with the others, by the share of equal minima, so a bucket costs as many rows as it has
    documents. Those unlike the first one form the bucket again without it.
    """
    members = heads.select(F.explode("_bands").alias("b"), "_id")
    minima_of = heads.select(F.col("_id").alias("_who"), "_minima")
    links = None
    for k in range(STAR_ROUNDS + 1):
        first = members.groupBy(F.col("b").alias("_b")).agg(F.min("_id").alias("m"), F.max("_id").alias("_m"))
        first = first.where(F.col("m") < F.col("_m")).drop("_m")
        members = stored(
            members.join(first, F.col("b") == F.col("_b")).where(F.col("_id") != F.col("m")).drop("_b"),
            "bucket-members",
        )
        pairs = members.select(F.col("_id").alias("u"), F.col("m").alias("v")).distinct()
        if links is not None and members.isEmpty():
            return components(links)
        if k == STAR_ROUNDS:
            return components(links.union(pairs))
        judged = stored(
            pairs.join(minima_of, F.col("u") == F.col("_who"))
            .select("u", "v", F.col("_minima").alias("_a"))
            .join(minima_of, F.col("v") == F.col("_who"))
            .select("u", "v", "_a", F.col("_minima").alias("_b"))
            .mapInArrow(_share, "u long, v long, share double"),
            "judged",
        )
        near = judged.where(F.col("share") >= FAMILY_SHARE).select("u", "v")
        links = near if links is None else links.union(near)
        unlike = judged.where(F.col("share") < FAMILY_SHARE)
        members = members.join(
            unlike, (F.col("_id") == F.col("u")) & (F.col("m") == F.col("v")), "left_semi"
        ).select("b", "_id")


def _share(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        a, b = (
            np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(n, -1) for c in ("_a", "_b")
        )
        share = (a == b).mean(1) if n else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch["u"], batch["v"], pa.array(share)], names=["u", "v", "share"])


def confirmed_links(rows: DataFrame, families_: DataFrame, k: int, percent: int) -> DataFrame:
    """``u, v``: links of families that full sets confirm, as stars in each pair of blocks.

    A family is dealt into blocks, and each pair of blocks is one task's work, however large
    the family is. In a pair of blocks all intersections are counted by products of the
    sets' rows over the shingles that two or more share.
    """
    sizes = families_.groupBy(F.col("component").alias("_c")).agg(F.count("*").alias("_size"))
    placed = families_.join(sizes, F.col("component") == F.col("_c")).select(
        F.col("id").alias("_of"),
        "component",
        F.ceil(F.col("_size") / BLOCK).alias("_blocks"),
    )

    def sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingle_sets(batch["_text"], k)
            ends = np.concatenate([[0], np.cumsum(sets.counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["component"], batch["_blocks"], lists],
                names=["_id", "component", "_blocks", "_set"],
            )

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_of(batches, ["component", "_x", "_y"]):
            u, v = similar(run["_id"].to_numpy(), run["_set"].combine_chunks(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    mine = F.pmod(F.xxhash64("_id"), F.col("_blocks"))
    # Families grow with the corpus, so the texts meet them by a merge at every size.
    return (
        rows.join(placed.hint("merge"), F.col("_id") == F.col("_of"))
        .select("_id", "component", "_blocks", "_text")
        .mapInArrow(sets_of, "_id long, component long, _blocks long, _set array<long>")
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .select(
            "component",
            F.least("_mine", "_other").alias("_x"),
            F.greatest("_mine", "_other").alias("_y"),
            "_id",
            "_set",
        )
        .repartition("component", "_x", "_y")
        .sortWithinPartitions("component", "_x", "_y")
        .mapInArrow(confirm, "u long, v long")
    )


def similar(ids: np.ndarray, sets: pa.ListArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all similar sets, as few as do (each id to the smallest it reaches)."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(
        sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True
    )
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((n, n), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, top, STEP_COLUMNS):
        stop = min(start + STEP_COLUMNS, top)
        a, b = np.searchsorted(column, [start, stop])
        part = np.zeros((n, stop - start), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (100 * common >= percent * union) & (sizes > 0)[:, None]
    root = np.full(n, -1)
    for start in order.tolist():  # from the smallest id on, each takes what it reaches
        if root[start] >= 0:
            continue
        root[start] = start
        edge = np.array([start])
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(0) & (root < 0))
            root[edge] = start
    joined = np.flatnonzero(ids != ids[root])
    return ids[joined], ids[root[joined]]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their sets of ``k``-word shingles (A-Z in lower case, words
    between ASCII white space) have at least ``percent`` of their union in common.
    ``component_id`` is the smallest id reachable over links, ``kept`` says it is the own.

    1. Equal sets form a class, for which its smallest id stands.
    2. ``BANDS * ROWS`` minima of a set make ``BANDS`` bucket names. Buckets and shares of
       equal minima give families, which need not be exact: they only say what to compare.
    3. In each family full sets confirm links, block by block.
    4. Components of the confirmed links, by large and small stars.

    Texts without a word have an empty set and are linked with nothing. Null text counts as
    empty. A null id counts as the largest. Rows that repeat an id count as one document
    for links: what is linked with one of them is linked with all. No rows give no rows.
    """
    rows = corpus(docs, id_col, text_col)
    signed = stored(rows.mapInArrow(_sign(k, BANDS, ROWS), SIGNATURES), "signatures")
    classes = signed.where(F.col("_n") > 0).groupBy(
        F.col("_n").alias("_cn"), F.col("_s1").alias("_c1"), F.col("_s2").alias("_c2")
    ).agg(F.min("_id").alias("_head"))
    classes = stored(classes, "classes")
    heads = signed.where(F.col("_n") > 0).join(
        classes.select(F.col("_head").alias("_h")), F.col("_id") == F.col("_h"), "left_semi"
    )
    heads = stored(heads.select("_id", "_bands", "_minima"), "heads")
    links = confirmed_links(rows, families(heads), k, percent)
    joined = components(links)
    classes = classes.join(joined, F.col("_head") == F.col("id"), "left").select(
        "_cn", "_c1", "_c2", F.coalesce("component", "_head").alias("_component")
    )
    placed = signed.select("_id", "_n", "_s1", "_s2").join(
        classes,
        (F.col("_n") == F.col("_cn")) & (F.col("_s1") == F.col("_c1")) & (F.col("_s2") == F.col("_c2")),
        "left",
    )
    component = F.coalesce("_component", "_id")
    return placed.select(
        given_id().alias("doc_id"),
        F.col("_n").alias("n_shingles"),
        F.when(component != F.lit((1 << 63) - 1), component).alias("component_id"),
        (F.col("_id") == component).alias("kept"),
    )
