"""Repeated passages by recompression: equal substrings get equal names inside.

A text starts as a row of word names. The first round names runs of equal words, every
further round names pairs: each symbol is a left or a right one by a bit of its name, and a
left symbol joins a right one that follows it. Names are 64-bit hashes of what they stand
for, so all tasks give the same name to the same symbol without asking each other.

Beside its words every symbol keeps the span of words that decides it. Where these words
stand again, the symbol stands again. So a window chooses the longest of the symbols whose
whole span it holds; if no other window chooses its name it cannot be repeated. All other
windows are verified by 96-bit hashes of their words; so names are hashes that no round of Spark deals
out, and equality rests on hashes, not on a comparison of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import covered
from .tables import corpus, given_id, hashed, mix, split_words, starts_of, steps, stored

WINDOW = 20
ROUNDS = 4

#: Names are sent without their last bits. Should two become equal, their windows are
#: verified in vain, which costs time but no correctness.
NAME_SHIFT = 16

NEVER = 1 << 40  # a distance beyond any text


class Symbols(NamedTuple):
    name: np.ndarray  # uint64
    first: np.ndarray  # first word
    low: np.ndarray  # words that decide the symbol, from ...
    high: np.ndarray  # ... to, end exclusive; beyond the text: undecided by its words


def recompress(words: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols of texts that lie side by side; ``text`` numbers the text of each word."""
    if not len(words):
        none = np.zeros(0, np.int64)
        return Symbols(words, none, none, none)
    name, first, low, high, text = _runs(words, text)
    for k in range(rounds):
        name, first, low, high, text = _pairs(name, first, low, high, text, k)
    return Symbols(name, first, low, high)


def _runs(words: np.ndarray, text: np.ndarray):
    """Name maximal runs of one word; their neighbours belong to what decides them."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    long = last - first
    name = np.where(long > 1, mix(words[first] ^ mix(long.astype(np.uint64), 1)), words[first])
    text = text[first]
    same = text[1:] == text[:-1]
    low, high = first - 1, last + 1
    low[np.append(True, ~same)] = -NEVER
    high[np.append(~same, True)] = NEVER
    return name, first, low, high, text


def _pairs(name, first, low, high, text, k: int):
    """Join each left symbol with the right one after it."""
    left = mix(name, k + 2) & np.uint64(1) > 0
    follows = np.append(text[1:] == text[:-1], False)  # the next symbol is of the same text
    joins = follows.copy()
    joins[:-1] &= left[:-1] & ~left[1:]
    joined = np.append(False, joins[:-1])
    next_low, next_high = np.append(low[1:], 0), np.append(high[1:], 0)
    past_low, past_high = np.append(0, low[:-1]), np.append(0, high[:-1])
    after = np.append(False, follows[:-1])  # the symbol before is of the same text
    # A left symbol is decided with the one after it, a right one with the one before.
    new_low = np.where(
        left,
        np.where(follows, np.minimum(low, next_low), low),
        np.where(after, np.minimum(low, past_low), -NEVER),
    )
    new_high = np.where(
        left,
        np.where(follows, np.maximum(high, next_high), NEVER),
        np.where(after, np.maximum(high, past_high), high),
    )
    pair = np.flatnonzero(joins)
    name = name.copy()
    with np.errstate(over="ignore"):
        name[pair] = mix(name[pair] * np.uint64(3) ^ mix(name[pair + 1], 1))
    kept = ~joined
    return name[kept], first[kept], new_low[kept], new_high[kept], text[kept]


def choices(symbols: Symbols, row: np.ndarray, counts: np.ndarray, window: int):
    """For each window the longest symbol it holds with all that decides it (of equally long
    ones the least name), as two arrays: symbols and starts.

    Equal windows hold the same such symbols, so they choose the same name: a window whose
    name is chosen nowhere else is not repeated, and no other name need be known. Long symbols
    are the rare ones.
    """
    begins = starts_of(counts)
    from_ = np.maximum(symbols.high - window, begins[row])
    to = np.minimum(symbols.low, (begins + counts)[row] - window)
    at = np.flatnonzero((from_ <= to) & (symbols.high < NEVER) & (symbols.low > -NEVER))
    sizes = (to - from_ + 1)[at]
    symbol = np.repeat(at, sizes)
    start = np.repeat(from_[at] - starts_of(sizes), sizes) + np.arange(int(sizes.sum()))
    long = np.diff(np.append(symbols.first, counts.sum()))  # symbols lie side by side
    short = (63 - np.minimum(long, 63)).astype(np.uint64) << np.uint64(58)
    key = (short | symbols.name >> np.uint64(6))[symbol]
    least = np.full(int(counts.sum()), np.iinfo(np.uint64).max)
    np.minimum.at(least, start, key)
    chosen = key == least[start]
    return symbol[chosen], start[chosen]


def open_windows(choice, alone: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Starts of windows that choose no symbol whose name is ``alone``."""
    symbol, start = choice
    n = int(counts.sum())
    free = np.ones(n, bool)
    free[start[alone[symbol]]] = False
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(free & (np.arange(n) + window <= ends))


def window_hashes(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of the words of each window."""
    other = mix(words, 99)
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            a = a * np.uint64(0x9E3779B97F4A7C15) + words[at + j]
            b = b * np.uint64(0xC2B2AE3D27D4EB4F) + other[at + j]
    return mix(a), mix(b) >> np.uint64(32)


def _first_of_equals(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by ``keys``, and for each place in it the place of its first equal."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    heads = np.flatnonzero(new)
    return order, heads[np.cumsum(new) - 1] if len(order) else heads


def _lists(where: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """``values`` as one list for each of ``n`` rows; ``where`` (sorted) names their row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def _ties(where: np.ndarray, texts: np.ndarray, n: int) -> pa.Array:
    """As ``_lists``, for numbers of texts; null where there are none."""
    sizes = np.bincount(where, minlength=n)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(texts.astype(np.int64))
    )
    return pc.if_else(pa.array(sizes > 0), lists, pa.scalar(None, lists.type))


def _parsed(batch: pa.RecordBatch, rounds: int):
    words, counts = split_words(batch["_text"])
    names = hashed(words)
    text = np.repeat(np.arange(len(counts)), counts)
    symbols = recompress(names, text, rounds)
    row = text[symbols.first] if len(names) else text
    # Symbols are numbered from 0 in each text.
    number = np.arange(len(row)) - starts_of(np.bincount(row, minlength=len(counts)))[row]
    return names, counts, symbols, row, number


# What a task asks and knows: a name (or window) to look up in the whole corpus with the
# place to answer to, or what it has found out itself about one text, under a key of its
# own so that no task gathers these. An id need not name one text, so the place to answer
# to is the number of the text; windows have the id beside it for their order, and the
# other texts of the task that have the same window at the same place of the same id.
ASKED = "_key long, _also long, _row long, _at int, _known array<int>"
ASKED_IN_ORDER = ASKED + ", _id long, _ties array<long>"


def _asked(key, also, rows, at, known_rows, known: pa.Array, **more: pa.Array) -> pa.RecordBatch:
    n, m = len(key), len(known_rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key.view(np.int64), mix(known_rows.view(np.uint64)).view(np.int64)])),
            pa.array(np.concatenate([also.view(np.int64), np.arange(m)])),
            pa.array(np.concatenate([rows, known_rows])),
            pa.array(np.concatenate([at, np.zeros(m, np.int64)]).astype(np.int32)),
            pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), known]),
            *[pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in more.values()],
        ],
        names=["_key", "_also", "_row", "_at", "_known", *more],
    )


def _name_symbols(window: int, rounds: int) -> Callable:
    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = batch["_row"].to_numpy()
            _, counts, s, row, number = _parsed(batch, rounds)
            useful = np.unique(choices(s, row, counts, window)[0])
            order, head = _first_of_equals(s.name[useful])
            size = np.bincount(head, minlength=len(order))
            first = np.flatnonzero(size > 0)
            asks = np.sort(useful[order[first]])  # rows of a document stay together
            # A name that a task has twice is repeated: one row says so to the others.
            twice = np.sort(useful[order[size[head] > 1]])
            some, where = np.unique(row[twice], return_inverse=True)
            yield _asked(
                s.name[asks] >> np.uint64(NAME_SHIFT),
                np.zeros(len(asks), np.int64),
                rows[row[asks]],
                number[asks],
                rows[some],
                _lists(where, number[twice], len(some)),
            )

    return name


def _name_windows(window: int, rounds: int) -> Callable:
    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids, rows = batch["_id"].to_numpy(), batch["_row"].to_numpy()
            words, counts, s, row, number = _parsed(batch, rounds)
            alone = np.ones(len(row), bool)
            found, in_row = _flat(batch["_found"])
            per_row = np.bincount(row, minlength=len(counts))
            alone[starts_of(per_row)[in_row] + found] = False
            at = open_windows(choices(s, row, counts, window), alone, counts, window)
            a, b = window_hashes(words, at, window)
            begins = starts_of(counts)
            row = np.repeat(np.arange(len(counts)), counts)[at]
            place = at - begins[row]
            # In the order of id and place, which is stable: the head is the earliest.
            by = np.lexsort((rows[row], place, ids[row]))
            a, b, row, place = a[by], b[by], row[by], place[by]
            owner, text = ids[row], rows[row]
            order, head = _first_of_equals(a, b)
            chosen = order[head] if len(order) else order
            later = (owner[order] != owner[chosen]) | (place[order] != place[chosen])
            again = np.sort(order[later])
            again = again[np.argsort(row[again], kind="stable")]
            some, where = np.unique(row[again], return_inverse=True)
            asks = np.unique(head)
            # Other texts with the window at the very place of the head get the same answer.
            tied = np.flatnonzero(~later & (text[order] != text[chosen]))
            ties = _ties(np.searchsorted(asks, head[tied]), text[order[tied]], len(asks))
            asks = order[asks]
            sent = np.argsort(row[asks], kind="stable")  # rows of a document stay together
            asks = asks[sent]
            yield _asked(
                a[asks],
                b[asks],
                text[asks],
                place[asks],
                rows[some],
                _lists(where, place[again], len(some)),
                _id=pa.array(owner[asks]),
                _ties=ties.take(pa.array(sent)),
            )

    return name


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array of lists (null: none), and the row of each."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return (
        lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        np.repeat(np.arange(len(sizes)), sizes),
    )


def _by_text(answers: DataFrame, hit: Column, name: str, also: str, ties: bool = False) -> DataFrame:
    """What is known of each text: a task's own findings, and the answers to its questions."""
    known = F.coalesce("_known", F.when(hit, F.array("_at")))
    found = answers.withColumn("_k", known).where(F.col("_k").isNotNull())
    if ties:
        texts = F.when(F.col("_ties").isNull(), F.array("_row")).otherwise(
            F.concat(F.array("_row"), "_ties")
        )
        found = found.select(F.explode(texts).alias("_row"), "_k")
    return (
        found.groupBy(F.col("_row").alias(also))
        .agg(F.array_distinct(F.flatten(F.collect_list("_k"))).alias(name))
    )


def drop_repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    rounds: int = ROUNDS,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``, ``kept`` (text).

    Words are runs of anything but ASCII white space. A word goes when a window of
    ``window`` consecutive words that covers it also starts earlier: in a document with a
    smaller id, or earlier in the same one. Windows are judged on the input, not on what is
    left. Kept words are joined by one space.

    1. A text that is equal to one with a smaller id is repeated as a whole.
    2. The other texts are recompressed. Of the symbols that a window holds with all that
       decides them it chooses the longest, as an equal window does. A task asks once for each
       name that is chosen, however often, and learns which are chosen again anywhere.
    3. Windows without such a name of their own are hashed; a task asks once for each, for its
       earliest place, and knows by itself that its other places are later.
    4. The covered words of each document are merged and cut.

    So a passage that a third of all documents share sends one row per slice of a task. No
    window is sampled or left out. Null text counts as empty. A null id counts as the
    largest. Rows that repeat an id (or have none) start at the same places, so of windows
    at one place neither is the earlier one; what is found for one of them holds for those
    with the same text only. No rows give no rows.
    """
    rows = corpus(docs, id_col, text_col).withColumns(
        # Without a null the three joins below move the texts alike, and so only once.
        {"_md5": F.coalesce(F.unhex(F.md5("_text")), F.lit(b"")), "_long": F.length("_text")}
    )
    # Numbers of the texts hold from here on.
    originals = stored(
        rows.groupBy(F.col("_md5").alias("_same"), F.col("_long").alias("_size"))
        .agg(F.min("_id").alias("_own"))
        .withColumn("_row", F.monotonically_increasing_id()),
        "originals",
    )
    # With the id as a key, the copies of a text do not meet in one task.
    is_own = (
        (F.col("_md5") == F.col("_same"))
        & (F.col("_long") == F.col("_size"))
        & (F.col("_id") == F.col("_own"))
    )
    # What is found joins the numbers first, so texts move by one set of keys throughout.
    asked = rows.join(originals, is_own).select("_row", "_text").mapInArrow(_name_symbols(window, rounds), ASKED)
    same = Window.partitionBy("_key", "_also")
    answers = asked.withColumn("_n", F.count("*").over(same))
    found = _by_text(answers, F.col("_n") > 1, "_found", "_of")

    known = originals.join(found, F.col("_row") == F.col("_of"), "left")
    open_ = rows.join(known, is_own).select("_id", "_row", "_text", "_found")
    asked = open_.mapInArrow(_name_windows(window, rounds), ASKED_IN_ORDER)
    # Windows of one place (of a repeated id) have one rank, so none is later than another.
    answers = asked.withColumn("_rank", F.rank().over(same.orderBy("_id", "_at")))
    later = _by_text(answers, F.col("_rank") > 1, "_later", "_to", ties=True)

    cut = (
        rows.join(originals.join(later, F.col("_row") == F.col("_to"), "left"), is_own, "left")
        .select("_id", "_text", F.col("_own").isNull().alias("_copy"), "_later")
        .mapInArrow(
            _cutter(window, with_text),
            "_id long, n_words long, n_removed long, kept_sha256 string"
            + (", kept string" if with_text else ""),
        )
    )
    return cut.withColumn("_id", given_id()).withColumnRenamed("_id", "doc_id")


def _cutter(window: int, with_text: bool) -> Callable:
    import hashlib

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, counts = split_words(batch["_text"])
            begins = starts_of(counts)
            gone = np.zeros(len(words), bool)
            found, row = _flat(batch["_later"])
            if len(found):
                gone = covered(begins[row] + found, len(words), window)
            copy = batch["_copy"].to_numpy(zero_copy_only=False) & (counts >= window)
            gone |= np.repeat(copy, counts)
            left = words.filter(pa.array(~gone))
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[begins + counts] - sums[begins]
            ends = np.concatenate([[0], np.cumsum(counts - removed)]).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), left), " ")
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts.to_pylist()]
            columns = [batch["_id"], pa.array(counts), pa.array(removed), pa.array(sha)]
            names = ["_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(texts)
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut
