"""Two tokenizers on the same texts: which of their tokens share bytes, and how often."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import corpus, given_id, spread_join, starts_of, steps, stored
from .tokens import UNSAFE

#: Text aligned at once; each distinct piece of it is encoded once.
SLICE_BYTES = 4 << 20
#: A word of characters that no two libraries see differently, and how many make a text.
PLAIN, BUNCH = r"^ [!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]+$", 256
# Fixed value: the rule by which byte-level tokenizers cut texts.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Links of a group above which its ids are counted first.
LARGE_GROUP = 1 << 12
#: Irregular pairs with which a worker goes on before it hands them to the shuffle.
HELD_PAIRS = 1 << 20
#: Counts of irregular pairs (16 bytes each) are broadcast up to so many, else joined.
MAX_BROADCAST_PAIRS = 4_000_000

SUMS = ("n_a", "n_b", "n_groups", "n_links")


def align_tokens(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast: int = MAX_BROADCAST_PAIRS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``.

    A text, with a space before it, is encoded by a byte-level BPE (A, a ``tokenizers`` file)
    and by a piece BPE (B, a ``sentencepiece`` model that adds the space). Where a token of A
    and one of B end at the same byte, both sequences are cut: the tokens between two cuts are
    a group, and each token of A in it is linked to each of B. The count of an id pair is the
    number of rows that hold it linked. ``n_best`` are the links whose count is the highest of
    their A id in the corpus (ties included), ``count_sum`` is the sum over all links.

    An array gives each A id the B id of the same bytes. Pairs by that array, as almost all
    groups of one token each are, are counted in vectors as long as A's vocabulary, one for
    each task; only other pairs are shuffled, added up per task. The links of a row are stored
    as distinct pairs with their numbers, so texts are encoded once.

    A text that is null or empty, or whose bytes either tokenizer does not give back, has no
    tokens: zeros, and an empty string for the hash. A null id stays null; rows that repeat an
    id are rows of their own. No rows give none.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(path_a, path_b)
    width, same = len(vocabulary.bytes_b), vocabulary.same
    key = "int" if len(same) * width < 1 << 31 else "long"
    rows = stored(
        corpus(docs, id_col, text_col)
        .mapInArrow(
            _align(path_a, path_b, key),
            "_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            f"_keys array<{key}>, _times array<long>",
        )
        .withColumn("_row", F.monotonically_increasing_id()),
        "alignments",
    )
    counts = stored(
        rows.select("_keys")
        .mapInArrow(_count(same, width), "key long, regular boolean, n long")
        .groupBy("key", "regular")
        .agg(F.sum("n").alias("n")),
        "pair-counts",
    )
    # One number for each id of A, so as many as the vocabulary has.
    most = counts.groupBy(F.expr(f"key div {width}").alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = _vector(most, len(same))
    regular = counts.where("regular").select(F.expr(f"key div {width}").alias("a"), "n").toArrow()
    known = _vector(regular, len(same))
    irregular = counts.where("not regular").select("key", "n")
    fields = ["_id", *SUMS, "groups_sha256"]
    if irregular.count() <= max_broadcast:
        table = irregular.toArrow().sort_by("key")
        shared = spark.sparkContext.broadcast(
            (table["key"].to_numpy(), table["n"].to_numpy(), known, best, same)
        )
        schema = rows.select(*fields).schema.add("n_best", "long").add("count_sum", "long")
        out = rows.select(*fields, "_keys", "_times").mapInArrow(_look_up(shared, width), schema)
    else:
        out = _joined(rows, counts, width)
    return out.select(
        given_id().alias("doc_id"), *SUMS, "n_best", "count_sum", "groups_sha256"
    )


def _vector(table: pa.Table, length: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    out[table["a"].to_numpy()] = table["n"].to_numpy()
    return out


def _joined(rows: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """The same as ``_look_up`` for a table of pairs that is too large to send everywhere."""
    a = F.expr(f"key div {width}")
    best = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("_best"))
    judged = counts.join(F.broadcast(best), a == F.col("_a")).select(
        "key", "n", (F.col("n") == F.col("_best")).alias("_is_best")
    )
    links = rows.select(
        "_row", F.explode(F.arrays_zip(F.col("_keys").alias("k"), F.col("_times").alias("t"))).alias("l")
    ).select("_row", F.col("l.k").cast("long").alias("key"), F.col("l.t").alias("_t"))
    sums = (
        spread_join(links, judged, ["key"], F.xxhash64("_row"))
        .groupBy(F.col("_row").alias("_of"))
        .agg(
            F.sum(F.when(F.col("_is_best"), F.col("_t")).otherwise(0)).alias("n_best"),
            F.sum(F.col("_t") * F.col("n")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return rows.join(sums, F.col("_row") == F.col("_of"), "left").withColumns(
        {"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)}
    )


class Vocabulary:
    """The bytes of all ids of both tokenizers, and the B id of the same bytes for each A id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # in a text they are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _byte_of_character()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            spelled = all(c in byte for c in token)
            self.bytes_a[i] = bytes(map(byte.get, token)) if spelled else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        of_bytes = {x: i for i, x in enumerate(self.bytes_b)}
        self.same = np.array([of_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        # Both cut before a space and no white space: A by its rule, B as no piece of its goes
        # on with a space after other characters.
        with open(path_a, encoding="utf-8") as file:
            rules = json.load(file)
        cut = rules.get("pre_tokenizer") or {}
        by_rule = cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
        self.cuts = by_rule and all("▁" not in p.lstrip("▁") for p in pieces)
        self.fast = self._fast(rules) if by_rule else None

    def _fast(self, rules: dict) -> tiktoken.Encoding | None:
        """The same tokenizer by ranks, where ids go by the order of merges."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"]]
        vocabulary = rules["model"]["vocab"]
        ids = [vocabulary["".join(m)] for m in merges]
        single = {x for x in self.bytes_a if len(x) == 1}
        if rules.get("normalizer") or len(single) < 256 or ids != sorted(set(ids)):
            return None
        ranks = {self.bytes_a[i]: i for i in vocabulary.values()}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def _byte_of_character() -> dict[str, int]:
    """Byte-level tokens spell printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Aligner:
    """Alignments of pieces of text that both tokenizers encode on their own."""

    def __init__(self, path_a: str, path_b: str):
        self.words = Vocabulary(path_a, path_b)
        self.sizes_a = np.array([len(x) for x in self.words.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.words.bytes_b], np.int64)
        self.width = len(self.sizes_b)
        self.size = len(self.sizes_a) * self.width

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of some texts, each with its leading space, and their numbers."""
        texts = pc.binary_join_element_wise(" ", texts, "")
        unsafe = pc.match_substring_regex(texts, f"{UNSAFE}| $")
        if not self.words.cuts:
            unsafe = pa.array(np.ones(len(texts), bool))
        marked = pc.replace_substring(texts, " ", "\x00 ")
        lists = pc.split_pattern(pc.if_else(unsafe, pa.scalar("\x00", texts.type), marked), "\x00")
        pieces = lists.flatten()
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = starts_of(counts)
        if pc.any(unsafe).as_py():  # a text of one piece, after the empty one
            mask = np.zeros(len(pieces), bool)
            mask[starts[unsafe.to_numpy(zero_copy_only=False)] + 1] = True
            pieces = pc.replace_with_mask(pieces, pa.array(mask), texts.filter(unsafe))
        inner = np.ones(len(pieces), bool)
        inner[starts] = False  # what is before the first mark: nothing
        return pieces.filter(pa.array(inner)), counts - 1

    def encoded(self, texts: list[str]) -> tuple[tuple, tuple]:
        """Ids of all texts in one array, and their numbers, of A and of B.

        Plain words are encoded many at a time, one after another as in a text.
        """
        plain = np.zeros(len(texts), bool)
        if self.words.fast and self.words.cuts:
            plain = pc.match_substring_regex(pa.array(texts, pa.string()), PLAIN)
            plain = plain.to_numpy(zero_copy_only=False)
        together, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        words = [texts[i] for i in together.tolist()]
        rest = [texts[i] for i in alone.tolist()]
        sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        bunches = ["".join(words[i : i + BUNCH]) for i in range(0, len(words), BUNCH)]
        quick = (
            [self.words.fast.encode_ordinary(x) for x in bunches] if words else [],
            self.words.b.encode([x[1:] for x in bunches], num_threads=1),
        )
        slow = (
            [e.ids for e in self.words.a.encode_batch_fast(rest, add_special_tokens=False)],
            self.words.b.encode([t[1:] for t in rest], num_threads=1),
        )
        out = []
        for many, single, lengths in zip(quick, slow, (self.sizes_a, self.sizes_b)):
            flat = _flat(many)
            ends, want = np.cumsum(lengths[flat]), np.cumsum(sizes)
            upto = np.searchsorted(ends, want, "right")
            if len(want) and not (ends[upto - 1] == want).all():
                raise ValueError("a token runs over the end of a word")
            counts = np.zeros(len(texts), np.int64)
            counts[together] = np.diff(upto, prepend=0)
            counts[alone] = np.fromiter(map(len, single), np.int64, len(single))
            ids, of_plain = np.empty(counts.sum(), np.int64), np.repeat(plain, counts)
            ids[of_plain], ids[~of_plain] = flat, _flat(single)
            out.append((ids, counts))
        return tuple(out)

    def same_bytes(self, texts: list[str], ids_a, n_a, ids_b, n_b) -> np.ndarray:
        """Which texts both tokenizers give back."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        text, good = np.arange(len(raw)), np.ones(len(raw), bool)
        for ids, n, lengths in ((ids_a, n_a, self.sizes_a), (ids_b, n_b, self.sizes_b)):
            good &= np.bincount(np.repeat(text, n), weights=lengths[ids], minlength=len(raw)) == sizes
        want = np.frombuffer(b"".join([x for x, g in zip(raw, good.tolist()) if g]), np.uint8)
        at = np.repeat(text[good], sizes[good])
        for ids, n, spelled in (
            (ids_a, n_a, self.words.bytes_a),
            (ids_b, n_b, self.words.bytes_b),
        ):
            kept = ids[np.repeat(good, n)].tolist()
            got = np.frombuffer(b"".join([spelled[i] for i in kept]), np.uint8)
            other = np.flatnonzero(got != want)
            if len(other):  # with the lengths of before, which ``at`` goes by
                wrong = np.unique(at[other])
                stays = ~np.isin(at, wrong)
                good[wrong], at, want = False, at[stays], want[stays]
        return good

    def aligned(self, texts: list[str]) -> Alignment:
        (ids_a, n_a), (ids_b, n_b) = self.encoded(texts)
        good = self.same_bytes(texts, ids_a, n_a, ids_b, n_b)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        # Where both sequences of ends meet, groups end; all texts end there.
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        last_a, last_b = _held_by(ends_a, ends_b), _held_by(ends_b, ends_a)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        many_a = np.bincount(group_a, minlength=n_groups)
        many_b = np.bincount(group_b, minlength=n_groups)
        start_a, start_b = starts_of(many_a), starts_of(many_b)
        text = np.repeat(np.arange(len(texts)), n_a)[last_a]  # of each group
        keys, times, rows = self._links(ids_a, ids_b, many_a, many_b, start_a, start_b)

        def of_text(x: np.ndarray) -> np.ndarray:
            return np.bincount(text, weights=x, minlength=len(texts)).astype(np.int64)

        # As text, groups one after another: the ids of A, then those of B, and what follows.
        ids = np.empty(len(ids_a) + len(ids_b), np.int64)
        after = np.zeros(len(ids), np.int8)
        place_a = np.arange(len(ids_a)) + start_b[group_a]
        place_b = np.arange(len(ids_b)) + (start_a + many_a)[group_b]
        ids[place_a], ids[place_b] = ids_a, ids_b
        after[place_a[last_a]], after[place_b[last_b]] = 1, 2
        signs = pa.array([",", "|", ";"]).take(pa.array(after))
        spelled = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.string()), signs, "")
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(spelled).to_numpy(zero_copy_only=False))])
        bounds = bounds[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        data = spelled.buffers()[2].to_pybytes() if len(spelled) else b""
        return Alignment(
            good,
            np.column_stack([n_a, n_b, of_text(np.ones(n_groups)), of_text(many_a * many_b)]),
            of_text(rows),
            keys,
            times,
            [data[x:y] for x, y in pairwise(bounds)],
        )

    def _links(self, ids_a, ids_b, many_a, many_b, start_a, start_b):
        """Pairs of all groups, how often each is there, and rows by group. A row is a link,
        but in groups with very many links a pair of ids that differ."""
        rows = many_a * many_b
        large = np.flatnonzero(rows > LARGE_GROUP)
        found = []
        for g in large.tolist():
            a, n = np.unique(ids_a[start_a[g] : start_a[g] + many_a[g]], return_counts=True)
            b, m = np.unique(ids_b[start_b[g] : start_b[g] + many_b[g]], return_counts=True)
            found.append(((a[:, None] * self.width + b).ravel(), np.outer(n, m).ravel()))
            rows[g] = len(found[-1][0])
        first = starts_of(rows)
        total = int(rows.sum())
        group = np.repeat(np.arange(len(rows)), rows)
        at = np.arange(total) - first[group]
        a, b = np.divmod(at, many_b[group])
        # In a large group there are fewer rows than links, so these places exist.
        keys = ids_a[start_a[group] + np.minimum(a, many_a[group] - 1)] * self.width
        keys += ids_b[start_b[group] + b]
        times = np.ones(total, np.int64)
        for g, (pairs, n) in zip(large.tolist(), found):
            keys[first[g] : first[g] + len(pairs)], times[first[g] : first[g] + len(pairs)] = pairs, n
        return keys, times, rows


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


class Alignment(NamedTuple):
    """Of some texts: ``SUMS`` (zeros where the bytes differ), rows of links, and spellings, in
    which each group ends with a semicolon."""

    good: np.ndarray
    numbers: np.ndarray
    rows: np.ndarray
    keys: np.ndarray
    times: np.ndarray
    spelled: list[bytes]


def _held_by(these: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which of ``these`` are among ``those``; both ascend and end alike."""
    return those[np.searchsorted(those, these)] == these if len(these) else np.zeros(0, bool)


_aligners: dict[tuple[str, str], Aligner] = {}


def _align(path_a: str, path_b: str, key: str):
    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:  # one for each worker process
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        for batch in steps(batches, most=SLICE_BYTES):
            pieces, counts = aligner.pieces(batch["_text"])
            counts[pc.binary_length(batch["_text"]).to_numpy(zero_copy_only=False) == 0] = 0
            yield _rows(batch["_id"], aligner, pieces, counts, key)

    return align


def _rows(ids: pa.Array, aligner: Aligner, pieces: pa.Array, counts: np.ndarray, key: str):
    n = len(ids)
    if len(pieces) != counts.sum():  # the lone space of an empty text is no piece
        pieces = pieces.filter(pa.array(np.repeat(counts > 0, np.maximum(counts, 1))))
    coded = pieces.dictionary_encode()
    table = aligner.aligned(coded.dictionary.to_pylist())
    at = coded.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(n), counts)
    if not table.good.all():  # a text with such a piece has no tokens
        lost = np.zeros(n, bool)
        lost[text[~table.good[at]]] = True
        at, text = at[~lost[text]], text[~lost[text]]
    bounds = np.searchsorted(text, np.arange(n + 1))
    totals = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[bounds]) for x in table.numbers.T]
    links = table.rows[at]
    places = np.repeat(starts_of(table.rows)[at] - starts_of(links), links)
    places += np.arange(len(places))
    of = np.repeat(text, links)
    pair, number = table.keys[places], table.times[places]
    del places
    pair, number, of = _summed(pair, number, of, aligner.size)
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    at = at.tolist()
    digests = [
        hashlib.sha256(b"".join([table.spelled[i] for i in at[a:b]])[:-1]).hexdigest() if b > a else ""
        for a, b in pairwise(bounds.tolist())
    ]
    kind = pa.int32() if key == "int" else pa.int64()
    return pa.RecordBatch.from_arrays(
        [
            ids,
            *[pa.array(x) for x in totals],
            pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(pair).cast(kind)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(number)),
        ],
        names=["_id", *SUMS, "groups_sha256", "_keys", "_times"],
    )


def _summed(pair: np.ndarray, number: np.ndarray, of: np.ndarray, size: int):
    """Distinct pairs of each text in order, with the sums of their numbers."""
    if size * (int(of[-1]) + 1 if len(of) else 1) < 1 << 62:
        keys = of * size + pair
        order = None if (number == 1).all() else np.argsort(keys)
        keys = np.sort(keys) if order is None else keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        of, pair = np.divmod(keys[first], size)
    else:
        order = np.lexsort((pair, of))
        pair, of = pair[order], of[order]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        pair, of = pair[first], of[first]
    if order is None:
        return pair, np.diff(np.append(first, len(number))), of
    return pair, np.add.reduceat(number[order], first) if len(first) else number, of


def _count(same: np.ndarray, width: int):
    """In how many rows each pair is linked. Keys of a row are distinct."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regular, held, n_held = np.zeros(len(same), np.int64), [], 0
        for batch in batches:
            keys = batch["_keys"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            a = keys // width
            is_same = same[a] == keys % width
            regular += np.bincount(a[is_same], minlength=len(same))
            pair, n = np.unique(keys[~is_same], return_counts=True)
            held.append((pair, n))
            n_held += len(pair)
            if n_held > HELD_PAIRS:
                held = [_added(held)]
                n_held = len(held[0][0])
                if n_held > HELD_PAIRS // 2:
                    yield _counted(*held.pop(), False)
                    n_held = 0
        if held:
            yield _counted(*_added(held), False)
        ids = np.flatnonzero(regular)
        yield _counted(ids * width + same[ids], regular[ids], True)

    return count


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(pairs))
    return pairs, sums.astype(np.int64)


def _counted(keys: np.ndarray, n: np.ndarray, regular: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(np.full(len(keys), regular)), pa.array(n, pa.int64())],
        names=["key", "regular", "n"],
    )


def _look_up(shared, width: int):
    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, numbers, known, best, same = shared.value
        for batch in batches:
            lists = batch["_keys"]
            keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            times = batch["_times"].flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            a = keys // width
            n = known[a]
            other = np.flatnonzero(same[a] != keys % width)
            n[other] = numbers[np.searchsorted(pairs, keys[other])] if len(other) else 0
            # Sums over the links of a row, exact in 64 bits.
            upto = np.concatenate([[0], np.cumsum(sizes)])
            is_best = np.concatenate([[0], np.cumsum(np.where(n == best[a], times, 0))])
            total = np.concatenate([[0], np.cumsum(times * n)])
            columns = [c for c in batch.schema.names if c not in ("_keys", "_times")]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c] for c in columns],
                    pa.array(np.diff(is_best[upto])),
                    pa.array(np.diff(total[upto])),
                ],
                names=[*columns, "n_best", "count_sum"],
            )

    return look_up
