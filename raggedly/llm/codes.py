"""Token ids as directly addressable codes: any token can be read without its block.

An id is split into chunks of ``CHUNK`` bits, the lowest first. Level 0 holds the first
chunk of every id, level 1 the second chunk of those that have more, and so on. A bitmap
beside each level but the last says which ids go on; the rank of a position in it (from a
directory with one number for each ``BLOCK`` bits, and the bits of one block) is the
position on the next level.

A corpus is a Parquet folder of segments, sorted by document id: part and place of a
segment, its ids and ends of documents, and its levels as bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import corpus, given_id, steps
from .tokens import SLICE_BYTES, encoder

CHUNK = 8
BLOCK = 512

SEGMENTS = (
    "part int, place long, n_tokens long, doc_ids binary, doc_ends binary, "
    "levels array<struct<chunks:binary,bits:binary,ranks:binary>>"
)
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


class Level(NamedTuple):
    chunks: np.ndarray  # uint8
    bits: np.ndarray  # uint8, packed, the first position in the highest bit
    ranks: np.ndarray  # uint32, ones before each block


def encode(ids: np.ndarray) -> list[Level]:
    """Levels of ids; at least one, as many as the largest id has chunks."""
    rest, levels = ids.astype(np.uint64), []
    while True:
        chunks = (rest & np.uint64((1 << CHUNK) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(CHUNK)
        more = rest > 0
        if not more.any():
            empty = np.zeros(0, np.uint8)
            return [*levels, Level(chunks, empty, np.zeros(0, np.uint32))]
        bits = np.packbits(more)
        per_byte = np.concatenate([[0], np.cumsum(_ONES[bits])])
        levels.append(Level(chunks, bits, per_byte[: len(bits) : BLOCK // 8].astype(np.uint32)))
        rest = rest[more]


def rank(level: Level, at: np.ndarray) -> np.ndarray:
    """Ones before each position, from the directory and the bits of one block."""
    block = at // BLOCK
    inside = np.arange(BLOCK // 8)
    index = block[:, None] * (BLOCK // 8) + inside
    bits = level.bits[np.minimum(index, len(level.bits) - 1)]
    whole = (at % BLOCK) // 8
    counts = np.where(inside < whole[:, None], _ONES[bits], 0).sum(1)
    last = bits[np.arange(len(at)), np.minimum(whole, BLOCK // 8 - 1)]
    counts += _ONES[last & ~(0xFF >> (at % 8)) & 0xFF]
    return level.ranks[np.minimum(block, len(level.ranks) - 1)].astype(np.int64) + counts


def at(levels: Sequence[Level], positions: np.ndarray) -> np.ndarray:
    """The ids at any positions."""
    here = np.asarray(positions, np.int64)
    out, who = np.zeros(len(here), np.uint64), np.arange(len(here))
    for k, level in enumerate(levels):
        out[who] |= level.chunks[here].astype(np.uint64) << np.uint64(CHUNK * k)
        if not len(level.bits) or not len(here):
            break
        on = (level.bits[here // 8] >> (7 - here % 8).astype(np.uint8)) & 1 > 0
        here, who = rank(level, here[on]), who[on]
    return out.astype(np.uint32)


def between(levels: Sequence[Level], start: int, stop: int) -> np.ndarray:
    """The ids of a range: one rank a level, then chunks that lie side by side."""
    out, who = np.zeros(stop - start, np.uint32), np.arange(stop - start)
    for k, level in enumerate(levels):
        out[who] |= level.chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK * k)
        if not len(level.bits) or start == stop:
            break
        bits = np.unpackbits(level.bits[start // 8 : (stop + 7) // 8])
        who = who[bits[start % 8 : start % 8 + stop - start] > 0]
        start = int(rank(level, np.array([start]))[0])
        stop = start + len(who)
    return out


def write_codes(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    cut: str = "space",
) -> None:
    """Encode every whole text, append ``end``, and write segments in ascending id order.

    Ids are range-sorted, so that part after part and place after place is the order of the
    corpus. Null text counts as empty: its document is ``end`` alone. A null id counts as
    the largest. Rows that repeat an id follow each other, in an order by a hash of the
    text; as ranges are cut inside an id too, no id is bound to one task. No rows write no
    segment.
    """

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        encode_texts = encoder(tokenizer, cut).encode
        for batch in steps(batches, most=SLICE_BYTES):
            ids, counts = encode_texts(batch["_text"], end)
            levels = [
                {"chunks": x.chunks.tobytes(), "bits": x.bits.tobytes(), "ranks": x.ranks.tobytes()}
                for x in encode(ids)
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "place": pa.array([place], pa.int64()),
                    "n_tokens": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([batch["_id"].to_numpy().tobytes()], pa.binary()),
                    "doc_ends": pa.array([np.cumsum(counts).tobytes()], pa.binary()),
                    "levels": pa.array(
                        [levels],
                        pa.list_(
                            pa.struct([(n, pa.binary()) for n in ("chunks", "bits", "ranks")])
                        ),
                    ),
                }
            )
            place += len(ids)

    rows = corpus(docs, id_col, text_col).withColumn("_tie", F.xxhash64("_text"))
    (
        rows.repartitionByRange("_id", "_tie")
        .sortWithinPartitions("_id", "_tie")
        .select("_id", "_text")
        .mapInArrow(segments, SEGMENTS)
        .write.mode("overwrite")
        .parquet(path)
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: the ids of all documents before the segment."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    # One row per part of the file, so it can be broadcast: parts are the partitions of one
    # shuffle, some ten bytes each. Else the segments themselves would be shuffled.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        stored.groupBy(F.col("part").alias("_part"))
        .agg(F.sum("n_tokens").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return (
        stored.join(F.broadcast(parts), F.col("part") == F.col("_part"))
        .withColumn("start", F.col("_base") + F.col("place"))
        .drop("_part", "_base")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the file alone."""

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = _levels(row["levels"])
                who = np.frombuffer(row["doc_ids"], np.int64)
                ends = np.frombuffer(row["doc_ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                ids = between(levels, 0, row["n_tokens"]).astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(who),
                        pa.array(row["start"] + begins),
                        pa.array(ends - begins),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["_id", "start", "n_tokens", "ids_crc32"],
                )

    segments = read_segments(spark, path).select("start", "n_tokens", "doc_ids", "doc_ends", "levels")
    return segments.mapInArrow(
        documents, "_id long, start long, n_tokens long, ids_crc32 long"
    ).select(given_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``position, id`` for each ``position`` of the corpus; those beyond it are left out.

    Positions meet their segment by ranges of equal length: a segment is named once for
    each range it touches. Only the bytes that a position needs are looked at.
    """
    span = 1 << 20
    segments = read_segments(spark, path).withColumn(
        "_range",
        F.explode(
            F.sequence(
                F.floor(F.col("start") / span),
                F.floor((F.col("start") + F.greatest("n_tokens", F.lit(1)) - 1) / span),
            )
        ),
    )

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = np.array(row["_places"], np.int64)
                found = at(_levels(row["levels"]), places - row["start"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places), pa.array(found.astype(np.int64))], names=["position", "id"]
                )

    wanted = positions.select(F.col("position").cast("long").alias("_place")).withColumn(
        "_wanted", F.floor(F.col("_place") / span)
    )
    near = segments.select("part", "place", "start", "n_tokens", "_range").join(
        wanted, F.col("_range") == F.col("_wanted")
    )
    near = near.where(
        (F.col("_place") >= F.col("start")) & (F.col("_place") < F.col("start") + F.col("n_tokens"))
    )
    # At most ``span`` different places of a segment in a group; asking twice costs no space.
    groups = near.groupBy("part", "place", F.col("_range").alias("_r")).agg(
        F.collect_set("_place").alias("_places")
    )
    return (
        read_segments(spark, path)
        .select("part", "place", "start", "levels")
        .join(groups.drop("_r"), ["part", "place"])
        .select("start", "levels", "_places")
        .mapInArrow(tokens, "position long, id long")
    )


def _levels(stored: list[dict]) -> list[Level]:
    return [
        Level(
            np.frombuffer(x["chunks"], np.uint8),
            np.frombuffer(x["bits"], np.uint8),
            np.frombuffer(x["ranks"], np.uint32),
        )
        for x in stored
    ]
