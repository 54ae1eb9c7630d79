"""Graded quality by cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import corpus, given_id, hashed, mix, split_words, starts_of, steps, stored

#: Labelled rows that the model is fitted on at most, picked by a hash of the id.
SAMPLE_ROWS = 8_000
#: Hash buckets of features.
BUCKETS = 1 << 20
#: Letters that words are cut to as further features.
STEMS = (4, 5)
#: A document is selected when its grade is the highest with at least this probability.
#: On held-out labels: 98 % of toxic and over 99 % of low-quality documents go, and less
#: than 0.5 % of the others.
LEAST_TAIL = 0.8
#: A bucket gets a weight if its share of documents differs between grades by so many
#: standard errors, and so many documents have it.
LEAST_Z, LEAST_ROWS = 6.0, 6
EPOCHS, BATCH, RATE, SPARSITY = 40, 128, 0.03, 3e-4
PUNCTUATION = ".,;:!?\"'()[]{}|-"


class Model(NamedTuple):
    weights: np.ndarray  # one for each bucket
    thresholds: np.ndarray  # ascending, one between neighbouring grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade from 1 on, or a higher one."""
        return _sigmoid(scores[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Features(NamedTuple):
    buckets: np.ndarray  # of all texts, one after another; may repeat
    counts: np.ndarray  # of each text


def _tagged(values: np.ndarray, tag: int) -> np.ndarray:
    return (mix(values.astype(np.uint64), tag) % np.uint64(BUCKETS)).astype(np.int32)


def _vocabulary(words: pa.Array) -> np.ndarray:
    """Buckets of each word: the word in lower case without outer punctuation, and its stems."""
    plain = pc.utf8_trim(pc.utf8_lower(words), PUNCTUATION)
    columns = [_tagged(hashed(plain), 0)]
    for n in STEMS:
        columns.append(_tagged(hashed(pc.utf8_slice_codeunits(plain, 0, n)), n))
    return np.stack(columns, 1)


def _shapes(texts: pa.Array, words: pa.Array, codes: np.ndarray, row: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Buckets for what a text looks like: coarse levels of shares and sizes."""
    n = np.maximum(counts, 1)
    long = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1)

    def share(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / long

    again = np.append(False, (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])) if len(row) else row > 0
    repeats = np.bincount(row, weights=again, minlength=len(counts)) / n
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    levels = [
        np.minimum(repeats * 10, 9),
        np.minimum(kinds / n * 10, 9),
        np.minimum(share(r"\p{Lu}") * 20, 12),
        np.minimum(share(r"[^\p{L}\p{N}\s]") * 20, 12),
        np.minimum(share(r"\p{N}") * 20, 12),
        np.minimum(np.bincount(row, weights=lengths, minlength=len(counts)) / n, 20),
        np.log2(n),
    ]
    return np.stack([_tagged(np.floor(x), 100 + i) for i, x in enumerate(levels)], 1)


def _read(texts: pa.Array):
    """Distinct words of each text (as places in the vocabulary), and the shape's buckets."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    width = max(1, len(coded.dictionary))
    pairs = np.unique(row * width + codes)
    kinds = np.bincount(pairs // width, minlength=len(counts))
    return coded.dictionary, pairs // width, pairs % width, kinds, _shapes(texts, words, codes, row, counts, kinds)


def features(texts: pa.Array) -> Features:
    vocabulary, row, word, kinds, shapes = _read(texts)
    per_word = _vocabulary(vocabulary)[word]
    own = np.concatenate([np.repeat(row, per_word.shape[1]), np.repeat(np.arange(len(kinds)), shapes.shape[1])])
    all_ = np.concatenate([per_word.ravel(), shapes.ravel()])
    order = np.argsort(own, kind="stable")
    return Features(all_[order], np.bincount(own, minlength=len(kinds)))


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The same as the sum of the weights of ``features``; a word's weights are added once."""
    vocabulary, row, word, kinds, shapes = _read(texts)
    if not len(kinds):
        return np.zeros(0)
    per_word = weights[_vocabulary(vocabulary)].sum(1)
    return np.bincount(row, weights=per_word[word], minlength=len(kinds)) + weights[shapes].sum(1)


def fit(rows: Features, grades: np.ndarray, n_grades: int, seed: int = 3) -> Model:
    """Weights and ordered thresholds that make the grades likely, with an absolute penalty.

    P(grade <= j) = sigmoid(threshold_j - score). Thresholds are a first one and positive
    steps, so they stay ordered. Without rows, or with one grade only, weights are zero and
    the thresholds give the (smoothed) shares of the grades.
    """
    shares = (np.bincount(grades, minlength=n_grades) + 0.5) / (len(grades) + 0.5 * n_grades)
    below = np.clip(np.cumsum(shares)[:-1], 1e-4, 1 - 1e-4)
    start = np.log(below / (1 - below))
    # A score is a sum of many small weights; the start leaves room between thresholds.
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), start)
    rows = _screened(rows, grades, n_grades)
    names, columns = np.unique(rows.buckets, return_inverse=True)
    weights = np.zeros(len(names))
    begins = starts_of(rows.counts)
    rng = np.random.default_rng(seed)
    fast, slow = np.zeros(len(names)), np.zeros(len(names))
    free_slow = np.zeros(len(free))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(grades))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            sizes = rows.counts[some]
            at = np.repeat(begins[some] - starts_of(sizes), sizes) + np.arange(sizes.sum())
            index = columns[at]
            owner = np.repeat(np.arange(len(some)), sizes)
            score = np.bincount(owner, weights=weights[index], minlength=len(some))
            g_score, g_free = _gradient(score, grades[some], free)
            grad = np.bincount(index, weights=(g_score / len(some))[owner], minlength=len(names))
            step += 1
            fast = 0.9 * fast + 0.1 * grad
            slow = 0.999 * slow + 0.001 * grad**2
            rate = RATE * (1 - step / (EPOCHS * -(-len(order) // BATCH)))
            scale = rate / (np.sqrt(slow / (1 - 0.999**step)) + 1e-5)
            weights = weights - scale * fast / (1 - 0.9**step)
            weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * SPARSITY, 0)
            free_slow = 0.99 * free_slow + 0.01 * (g_free / len(some)) ** 2
            free = free - rate * (g_free / len(some)) / (np.sqrt(free_slow / (1 - 0.99**step)) + 1e-5)
    all_ = np.zeros(BUCKETS, np.float32)
    all_[names] = weights
    return Model(all_, _ordered(free))


def _screened(rows: Features, grades: np.ndarray, n_grades: int) -> Features:
    """Only buckets that tell neighbouring grades, or all below from all above, apart."""
    seen = np.zeros((n_grades, BUCKETS), np.int32)  # documents that have a bucket
    ends = np.cumsum(rows.counts)
    for i, grade in enumerate(grades.tolist()):
        seen[grade, np.unique(rows.buckets[ends[i] - rows.counts[i] : ends[i]])] += 1
    size = np.bincount(grades, minlength=n_grades)
    useful = np.zeros(BUCKETS, bool)
    for j in range(n_grades - 1):
        for low, high in (([j], [j + 1]), (range(j + 1), range(j + 1, n_grades))):
            n, m = size[list(low)].sum(), size[list(high)].sum()
            if n and m:
                a, b = seen[list(low)].sum(0), seen[list(high)].sum(0)
                p = (a + b + 1) / (n + m + 2)
                z = (a / n - b / m) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))
                useful |= (np.abs(z) >= LEAST_Z) & (a + b >= LEAST_ROWS)
    kept = useful[rows.buckets]
    sums = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])
    return Features(rows.buckets[kept], sums[ends] - sums[ends - rows.counts])


def _ordered(free: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def _gradient(score: np.ndarray, grades: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of minus log likelihood: by score, and by the free parameters of the thresholds."""
    thresholds = _ordered(free)
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    with np.errstate(over="ignore"):
        upper = 1 / (1 + np.exp(-(edges[grades + 1] - score)))
        lower = 1 / (1 + np.exp(-(edges[grades] - score)))
    p = np.maximum(upper - lower, 1e-12)
    by_upper, by_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_threshold = np.zeros(len(thresholds))
    for j in range(len(thresholds)):
        by_threshold[j] = by_lower[grades == j + 1].sum() - by_upper[grades == j].sum()
    tail = np.cumsum(by_threshold[::-1])[::-1]  # a step moves all thresholds after it
    return by_upper - by_lower, np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])


def train(
    docs: DataFrame,
    labels: DataFrame,
    grade: Column,
    n_grades: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on at most ``sample_rows`` labelled documents, the first by a hash of their id.

    Several labels of an id count as the lowest. Labels without a grade, an id or a
    document are left out. Features are made in tasks, and one task fits on the bounded
    sample of them; the driver gets the weights that are not zero.
    """
    chosen = (
        labels.select(labels[id_col].cast("long").alias("_of"), grade.cast("int").alias("_grade"))
        .where(F.col("_of").isNotNull() & F.col("_grade").between(0, n_grades - 1))
        .groupBy("_of")
        .agg(F.min("_grade").alias("_grade"))
        .orderBy(F.xxhash64("_of"), "_of")
        .limit(sample_rows)
    )
    rows = (
        corpus(docs, id_col, text_col)
        .join(F.broadcast(chosen), F.col("_id") == F.col("_of"))  # sample_rows rows at most
        .select("_id", "_grade", "_text")
    )

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            made = features(batch["_text"])
            values = made.buckets.astype("<i4").tobytes()
            ends = 4 * np.cumsum(made.counts)
            binary = [values[a:b] for a, b in zip((ends - 4 * made.counts).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["_grade"], pa.array(binary, pa.binary())], names=["_id", "_grade", "_f"]
            )

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, grades = [], []
        for batch in batches:  # in the order of ids: the same sample gives the same model
            parts += [np.frombuffer(x, "<i4") for x in batch["_f"].to_pylist()]
            grades += batch["_grade"].to_pylist()
        counts = np.array([len(x) for x in parts], np.int64)
        buckets = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        model = fit(Features(buckets, counts), np.array(grades, np.int64), n_grades)
        names = np.flatnonzero(model.weights)
        thresholds = np.arange(len(model.thresholds))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([names, -1 - thresholds])),
                pa.array(np.concatenate([model.weights[names].astype(float), model.thresholds])),
            ],
            names=["place", "value"],
        )

    sample = stored(rows.mapInArrow(featured, "_id long, _grade int, _f binary"), "sample-features")
    found = sample.repartition(1).sortWithinPartitions("_id", "_f").mapInArrow(
        fitted, "place long, value double"
    ).toArrow()
    if not found.num_rows:  # no labelled document, so no task ran
        none = np.zeros(0, np.int64)
        return fit(Features(none, none), none, n_grades)
    place, value = (found[c].to_numpy() for c in ("place", "value"))
    weights = np.zeros(BUCKETS, np.float32)
    weights[place[place >= 0]] = value[place >= 0]
    return Model(weights, value[place < 0][np.argsort(-place[place < 0])])


def grade_documents(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_tail: float = LEAST_TAIL,
    keep: Column | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, expected_grade, tail, kept, carried``.

    ``tail`` is the probability of the highest grade; ``kept`` says that it is at least
    ``least_tail``, or that the model has no weight at all (too few labels) and so cannot
    tell documents apart. ``expected_grade`` is the sum of the tails of all grades. The model is
    one number for each of ``BUCKETS`` buckets, whatever the data. Null text counts as
    empty, which has a shape and so a grade. Rows that repeat an id are graded each. No rows
    give no rows. ``carried`` hands ``keep`` through.
    """
    carried = F.lit(None).cast("string") if keep is None else keep
    rows = corpus(docs, id_col, text_col, carried=carried)

    def graded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            tails = model.tails(scores(batch["_text"], model.weights))
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["carried"], pa.array(tails.sum(1)), pa.array(tails[:, -1])],
                names=["_id", "carried", "expected_grade", "tail"],
            )

    schema = rows.select("_id", "carried").schema.add("expected_grade", "double").add("tail", "double")
    return rows.mapInArrow(graded, schema).select(
        given_id().alias("doc_id"),
        "expected_grade",
        "tail",
        (F.lit(not model.weights.any()) | (F.col("tail") >= least_tail)).alias("kept"),
        "carried",
    )
