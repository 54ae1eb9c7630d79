import random

import pytest

import corpus_pipeline as P
from raggedly.llm.tables import stored

from .test_lines import brute as line_brute
from .test_near import brute as near_brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with low quality, toxic ones, copies and sources of unequal size."""
    r = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        kind = i % 7
        words = [f"w{r.randrange(2000)}" for _ in range(r.randrange(20, 80))]
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[3] = f"badro{i % 5}"
        text = " ".join(words)
        if kind == 2:
            text = f"shared\nlines\nof all\n{text}"
        if kind == 3 and rows:
            text = rows[-1][1] + " end"
        rows.append((i, text, "en", f"s{i % 4 if i % 3 else 0}", len(text)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet"
    )
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in P.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        docs = stored(stage(spark, docs, sf_dir), "stage")
        rows = docs.collect()
        seen.append((name, before, rows))
        if stage is not P.packing:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows)
    (_, given, good), (_, _, cut), (_, _, single), (_, unmixed, mixed), (_, packed_in, packed) = seen
    kinds = [d % 7 for d, *_ in given]
    kept = {r.doc_id for r in good}
    assert sum(d in kept for d, *_ in given if d % 7 < 2) <= 0.05 * sum(k < 2 for k in kinds)
    assert sum(d in kept for d, *_ in given if d % 7 > 1) >= 0.95 * sum(k > 1 for k in kinds)
    want = [(d, t) for d, _, n, t in line_brute([(r.doc_id, r.text) for r in good]) if t or not n]
    assert sorted((r.doc_id, r.text) for r in cut) == want
    want = [d for d, _, _, keep in near_brute([(r.doc_id, r.text) for r in cut]) if keep]
    assert sorted(r.doc_id for r in single) == want and len(want) < len(cut)
    size = {d: len(t.split()) for d, t, _ in unmixed}
    total = {}
    for r in mixed:
        total[r.doc_id] = total.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 3 * size[d] for d, n in total.items())
    assert sum(size.values()) - 4 <= sum(total.values()) <= sum(size.values())
    assert {(d, p) for d in {d for d, *_ in packed_in} for p in [0]} <= {(r.doc_id, r.piece) for r in packed}
    assert sum(r.piece == 0 for r in packed) == len(packed_in)


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    used = {}
    for r in out.collect():
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 2048 for x in used.values())
    assert [name for name, _ in P.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "mixing to target weights", "best-fit packing"
    ]


def _documents(spark, rows):
    rows = [(d, t, "en", s, len(t)) for d, t, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_keeps_rows_that_are_like_nothing(spark, sf_dir):
    r = random.Random(8)
    alone = [(None if i % 2 else 5, " ".join(f"w{r.randrange(10**6)}" for _ in range(40)), f"s{i % 2}") for i in range(30)]
    first = " ".join(f"g{i}" for i in range(60))
    group = [(None, first, "s0"), (9, first + " x", "s0"), (7, first + " y", "s1"), (None, first, "s0")]
    none = " ".join(f"n{i}" for i in range(60))
    nulls = [(None, none + f" {i}", f"s{i % 3}") for i in range(6)]
    same = [(5, "one two three four five six", "s0"), (5, "one two three four five six", "s1")]
    rows = alone + group + nulls + same
    runs = []
    for _ in range(2):
        r.shuffle(rows)
        out = P.near_dedup(spark, _documents(spark, rows).repartition(3), sf_dir).collect()
        runs.append(sorted((x.doc_id or 0, x.text, x.source) for x in out))
    assert runs[0] == runs[1]
    got = [(d or None, t, s) for d, t, s in runs[0]]
    assert all(x in got for x in alone) and (7, first + " y", "s1") in got
    assert len(got) == len(alone) + 3


def test_mixing_with_repeated_and_null_ids(spark, sf_dir):
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(5, 40)))
    rows = [([None, 3, i][i % 3], text(), f"s{i % 2}") for i in range(60)]
    out = P.mixing(spark, _documents(spark, rows), sf_dir).collect()
    words = sum(len(t.split()) for _, t, _ in rows)
    assert words - 2 <= sum(len(x.text.split()) for x in out) <= words
    assert all(x.n_chars == len(x.text) for x in out)
    given = {t: (d, s) for d, t, s in rows}
    whole = {}
    for x in out:
        if x.text in given:
            assert given[x.text] == (x.doc_id, x.source)
            whole[x.text] = whole.get(x.text, 0) + 1
        else:
            assert any(t.startswith(x.text) and k == (x.doc_id, x.source) for t, k in given.items())
    assert max(whole.values()) <= 3
