import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from raggedly.llm import divergence
from raggedly.llm.divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=3, ranks=200):
    """``rows``: text, source, lang."""
    words, docs = defaultdict(Counter), defaultdict(Counter)
    for text, source, lang in rows:
        found = Counter(TERM.findall((text or "").translate(CAPITALS)))
        words[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        groups = {s: c for (x, s), c in words.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def weights(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = {s: weights(c) for s, c in groups.items()}
        q = weights(whole)
        for s in groups:
            pairs = [
                (sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s
            ]
            terms = [
                ((p[s][t] - q[t]) ** 2 // q[t], t)
                for t in kept if groups[s][t] and p[s][t] > q[t]
            ]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found, 1):
                    if part == "pair" or rank <= ranks:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in df.collect())


def corpus(n):
    """A source with most of the rows, words that all share, and many that few do."""
    out = []
    for i in range(n):
        lang = ["en", "en", "fr", None, ""][i % 5]
        source = ["hot", "hot", "b", "ü", None, ""][i * i % 6]
        text = f"The the THE é{i % 7} Éa w{chr(97 + i % 26)}{chr(97 + i % 11)} x-{'y' * (i % 4)}ß {'z' * (i % 3)}q"
        out.append((text * (i % 4), source, lang))
    return out


def table(make, rows):
    return make([(i, *r) for i, r in enumerate(rows)])


@pytest.mark.parametrize("ranks", [200, 5])
def test_against_brute_force(make, monkeypatch, ranks):
    monkeypatch.setattr(divergence, "BLOCK_COUNTS", 16)
    rows = corpus(160) + [
        (None, "only null", "en"), ("", "empty", "fr"), ("words of none other", "alone", "de"),
        ("\x00a\x7fb[c`d{e@f", "odd", "en"), ("word " * 4000, "long", "en"), ("the", "Z", "en"),
    ]
    df = table(make, rows + rows[:9])
    assert result(source_divergence(df, term_ranks=ranks)) == brute(rows + rows[:9], ranks=ranks)


def test_slices_and_batches_meet(spark, make, monkeypatch):
    monkeypatch.setattr(divergence, "COUNT_BYTES", 64)
    monkeypatch.setattr(divergence, "TABLE_CELLS", 8)
    rows = corpus(60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert result(source_divergence(table(make, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_source_has_no_pairs_and_equal_words_no_terms(make):
    rows = [("same words", "a", "en")] * 3
    assert result(source_divergence(table(make, rows))) == []
    rows += [("same words", "b", "en")] * 3
    assert result(source_divergence(table(make, rows))) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)
    ]


def test_empty_tables(make):
    assert source_divergence(make([])).collect() == []
    rows = [(None, "a", "en"), ("", "b", "en")]
    assert result(source_divergence(table(make, rows))) == brute(rows) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)
    ]


def test_weights_beyond_64_bits(spark):
    """The product of a count and 10**9 does not fit, the weight does."""
    from pyspark.sql import functions as F

    counts = [(7 * 10**12, 10**13 + 7, 123456), (0, 10**13, 9), (10**13 - 1, 10**13 - 9, 8)]
    df = spark.createDataFrame(counts, "c long, n long, v long")
    got = [r[0] for r in df.select(divergence.weight(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in counts]
    import numpy as np

    c, n, v = np.array(counts).T
    assert divergence._weights(c, n, v).tolist() == got


def test_rows_of_a_term_are_added_up_over_batches():
    rows = [("en", "a", "s", 1, 1)] * 5 + [("en", "b", "s", 1, 1), ("en", "b", "t", 2, 2), ("fr", "b", "s", 9, 9)]
    names = ["lang", "term", "source", "n", "d"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r))]) for r in rows]
    got = [tuple(r.values()) for b in divergence._added(3)(batches) for r in b.to_pylist()]
    assert got == [
        ("en", "a", "s", 5, 5, True), ("en", "b", "s", 1, 3, True), ("en", "b", "t", 2, 3, False),
        ("fr", "b", "s", 9, 9, True),
    ]
