"""Exact top-k inner products: vectors in norm buckets, pruned by local cosine thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Candidates and queries that one task compares; vectors of one bucket of near norms.
BLOCK_ROWS, BLOCK_QUERIES, BUCKET_ROWS = 16_384, 2_048, 512
#: Local cosine threshold from which coordinates prune; below, lengths alone do.
COORDINATE_COSINE = 0.7
#: Coordinates of a query, the largest ones, that bound its candidates.
FOCUS = 4
#: Sums below this are exact in double.
EXACT = 1 << 53

OUT = "query_id long, vec_id long, score long"


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``_id, _v``: each component x as floor(scale * x) in double arithmetic.

    Vectors that are null, empty, or hold a null or a value that is not finite, are left
    out, and so are rows with a null id.
    """
    v = df[vector_col].cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(df[id_col].isNotNull() & (F.size(v) > 0) & usable).select(
        df[id_col].cast("long").alias("_id"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("_v"),
    )


def top_products(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """Each query's ``k`` highest integer inner products: ``query_id, rank, vec_id, score``.

    ``is_query`` picks the queries by ``_id``; every vector but those with the query's own
    id is a candidate, if it has as many components. Ties go to the smaller id. A query
    with fewer candidates gets all of them, one without any gets no row. Rows that repeat
    an id are candidates each. No rows give no rows.

    Queries and candidates are dealt into blocks by hash, and every block of queries meets
    every block of candidates, so a task's size does not grow. In a task the candidates are
    grouped by length (norm), longest first. A query's local threshold for a bucket is the
    cosine that its longest vector would need to reach the query's k-th score so far: above
    1 the bucket and all after it are done; where it is high, the query's largest
    coordinates bound which vectors can qualify; else only those long enough do. What is
    left is verified by its product. A block hands on k rows a query.
    """
    all_ = stored(vectors(df, id_col, vector_col, scale), "vectors")
    queries = all_.where(is_query)
    n, q = all_.count(), queries.count()
    n_blocks, q_blocks = -(-max(n, 1) // BLOCK_ROWS), -(-max(q, 1) // BLOCK_QUERIES)

    def dealt(rows: DataFrame, own: str, own_blocks: int, other: str, blocks: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("_id"), F.lit(own_blocks))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        )

    left = dealt(queries, "_q", q_blocks, "_c", n_blocks).groupBy("_q", "_c")
    right = dealt(all_, "_c", n_blocks, "_q", q_blocks).groupBy("_q", "_c")

    def search(some: pa.Table, candidates: pa.Table) -> pa.Table:
        found = list(_blocks(some, candidates, k))
        columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found)]
        names = ["query_id", "vec_id", "score"]
        return pa.table(dict(zip(names, columns or [np.zeros(0, np.int64)] * 3)))

    near = left.cogroup(right).applyInArrow(search, OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _blocks(some: pa.Table, candidates: pa.Table, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Best rows of each query, by number of components."""
    for width, (ids, q) in _matrices(some).items():
        vec_ids, c = _matrices(candidates).get(width, (None, None))
        if c is not None:
            yield top_of_block(ids, q, vec_ids, c, k)


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    lists = table["_v"].combine_chunks()
    widths = lists.value_lengths().to_numpy(zero_copy_only=False)
    ids, out = table["_id"].to_numpy(), {}
    for width in np.unique(widths).tolist():
        mine = widths == width
        values = lists.filter(pa.array(mine)).flatten().to_numpy(zero_copy_only=False)
        out[width] = ids[mine], values.reshape(-1, width)
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in double where no sum can lose a digit, else in integers."""
    largest = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1]
    if largest < EXACT:
        return (q @ c.T).astype(np.int64)
    if largest >= 2.0**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return q.astype(np.int64) @ c.astype(np.int64).T


def top_of_block(
    ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, c: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query_id, vec_id, score`` of the k best candidates of each query."""
    norms, q_norms = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    order = np.lexsort((vec_ids, -norms))
    vec_ids, c, norms = vec_ids[order], c[order], norms[order]
    no = np.iinfo(np.int64)
    scores = np.full((len(ids), k), no.min)
    who = np.full((len(ids), k), no.max)
    filled = np.zeros(len(ids), np.int64)
    focus = np.argsort(-np.abs(q), axis=1, kind="stable")[:, :FOCUS]
    for start in range(0, len(c), BUCKET_ROWS):
        stop = min(start + BUCKET_ROWS, len(c))
        block, lengths, names = c[start:stop], norms[start:stop], vec_ids[start:stop]
        # A query with fewer than k results, or no bound above 0, must see everything.
        bound = np.where(filled == k, scores[:, -1], no.min).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound > 0, bound / (q_norms * lengths[0]), -1.0)
        # A hair of room for rounding; ties at the threshold stay in.
        open_ = cosine <= 1 + 1e-9
        if not open_.any():
            break
        sharp = open_ & (cosine >= COORDINATE_COSINE)
        for i in np.flatnonzero(sharp).tolist():
            keep = _by_coordinates(q[i], q_norms[i], focus[i], block, lengths, bound[i])
            if keep.any():
                _verify(np.array([i]), keep, ids, q, block, names, scores, who, filled, k)
        blunt = np.flatnonzero(open_ & ~sharp)
        if len(blunt):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.where(bound[blunt] > 0, bound[blunt] / q_norms[blunt], 0.0).min()
            keep = lengths >= shortest * (1 - 1e-9)
            _verify(blunt, keep, ids, q, block, names, scores, who, filled, k)
    row, column = np.nonzero(np.arange(k) < filled[:, None])
    return ids[row], who[row, column], scores[row, column]


def _by_coordinates(
    q: np.ndarray, q_norm: float, focus: np.ndarray, block: np.ndarray, norms: np.ndarray, bound: float
) -> np.ndarray:
    """Vectors whose focus coordinates leave room for ``bound``.

    The rest of the product is at most the product of the rests' lengths.
    """
    part = block[:, focus]
    rest_q = np.sqrt(max(0.0, q_norm**2 - (q[focus] ** 2).sum()))
    rest_c = np.sqrt(np.maximum(0.0, norms**2 - (part**2).sum(1)))
    return part @ q[focus] + rest_q * rest_c >= bound - 1e-6 * (abs(bound) + 1)


def _verify(who_q, keep, ids, q, block, names, scores, who, filled, k) -> None:
    """Products of some queries with the kept vectors, merged into their best k."""
    names = names[keep]
    found = products(q[who_q], block[keep])
    no = np.iinfo(np.int64)
    for j, i in enumerate(who_q.tolist()):
        mine = names != ids[i]
        if filled[i] == k:
            mine &= found[j] >= scores[i, -1]
        score = np.concatenate([scores[i, : filled[i]], found[j][mine]])
        name = np.concatenate([who[i, : filled[i]], names[mine]])
        if len(score) == filled[i]:
            continue
        best = np.lexsort((name, -score))[:k]
        filled[i] = len(best)
        scores[i], who[i] = no.min, no.max
        scores[i, : len(best)], who[i, : len(best)] = score[best], name[best]
