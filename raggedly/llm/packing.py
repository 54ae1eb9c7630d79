"""Pack documents into few sequences: minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running
from .tables import corpus, given_id, steps, stored
from .tokens import SLICE_BYTES, encoder

CAPACITY = 2048
PIECES = "_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one task of the ranking, on average.
BUCKET_ROWS = 8192


def cut_pieces(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: str = "words",
    with_ids: bool = False,
) -> DataFrame:
    """Documents as token ids, cut only where longer than ``capacity``.

    One row per piece: ``_id, piece, start, length, ids_crc32``, and ``ids`` if asked for.
    """

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(tokenizer, cut).encode
        for batch in steps(batches, most=SLICE_BYTES // 2):
            ids, counts = encode_texts(batch["_text"], end)
            n = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            begin = (np.cumsum(counts) - counts)[doc] + start
            ids = ids.astype("<u4")
            crc = [
                zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())
            ]
            columns = [
                pa.array(batch["_id"].to_numpy()[doc]),
                pa.array(piece.astype(np.int32)),
                pa.array(start),
                pa.array(length),
                pa.array(crc, pa.int64()),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, ids.astype(np.int32)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = corpus(docs, id_col, text_col)
    return rows.mapInArrow(pieces, PIECES + (", ids array<int>" if with_ids else ""))


def fullest(counts: Mapping[int, int], capacity: int) -> dict[int, int]:
    """How often to take each length so that the sum is the largest up to ``capacity``.

    Bit ``s`` of an integer says that the sum ``s`` can be reached; a length that is there
    ``c`` times is added 1, 2, 4, ... times at once. The search ends when ``capacity`` is
    reached, and the way back gives the lengths. Long lengths come first, so that short
    ones are left for gaps.
    """
    reach, mask, trail = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left > 0:
            times = min(power, left)
            trail.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, power = left - times, power * 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(trail):
        if not before >> total & 1:
            total -= length * times
            taken[length] = taken.get(length, 0) + times
    return taken


def plan_bins(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, lengths in each) until no piece is left.

    Each bin starts with the longest length left, and subset sums of the others find the
    fullest way to go on. The same bin is filled as often as the counts allow. After that
    one of its lengths is left less often than the bin took it, which halves at each return
    of the case: there are fewer than ``4 * capacity`` kinds of bin, however many pieces
    there are.
    """
    left, plan = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        rest = {n: c - (n == longest) for n, c in left.items() if c > (n == longest)}
        bin_ = fullest({n: c for n, c in rest.items() if n <= capacity - longest}, capacity - longest)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[n] // c for n, c in bin_.items())
        plan.append((times, bin_))
        for n, c in bin_.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces (any rows with a ``length`` of 1 to ``capacity``).

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver, which
    plans kinds of bins. Pieces are then numbered within their length, in buckets by hash
    so that a length that a third of all pieces have is numbered in many tasks, and each
    number finds its bin among the intervals of the plan. Their table is broadcast: it has
    fewer than ``4 * capacity`` kinds of bins of at most ``sqrt(2 * capacity)`` lengths, a few
    MB whatever the data.
    """
    spark = pieces.sparkSession
    kept = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, used, bins = [], dict.fromkeys(counts, 0), 0
    for times, bin_ in plan_bins(counts, capacity):
        offset = 0
        for length, c in sorted(bin_.items(), reverse=True):
            slots.append((length, used[length], used[length] + c * times, c, bins, offset))
            used[length] += c * times
            offset += c * length
        bins += times
    table = spark.createDataFrame(
        slots, "_length long, _from long, _to long, _each long, _bin long, _offset long"
    )
    bits = max(0, (sum(counts.values()) // BUCKET_ROWS).bit_length())
    key = F.xxhash64("_row")
    bucket = F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")
    ranked = running(
        kept.withColumn("_key", key), ["length"], ["_key", "_row"], bucket, {"_rank": F.lit(1)}
    )
    at = F.col("_rank") - 1
    within = at - F.col("_from")
    return (
        ranked.join(
            F.broadcast(table),
            (F.col("length") == F.col("_length")) & (at >= F.col("_from")) & (at < F.col("_to")),
        )
        .withColumn("sequence_id", F.col("_bin") + F.floor(within / F.col("_each")))
        .withColumn("offset", F.col("_offset") + within % F.col("_each") * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: str = "words",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text counts as empty: its document is the end id alone. A null id counts as the
    largest. Rows that repeat an id are packed each on their own. No rows give no rows.
    """
    pieces = cut_pieces(docs, tokenizer, end, capacity, id_col, text_col, cut, with_ids)
    packed = pack(pieces, capacity)
    return packed.withColumn("_id", given_id()).withColumnRenamed("_id", "doc_id")
