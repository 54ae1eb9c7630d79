import numpy as np
import pytest

from raggedly.operators import grid as G


def rows(spark, n=300, seed=0, labels=3):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([1, 1, 1], n).astype(np.float32)
    p[: n // 5] = np.round(p[: n // 5], 1)  # ties and thresholds
    y = rng.integers(0, labels, n)
    data = [(int(a), [float(v) for v in b], i // 50) for i, (a, b) in enumerate(zip(y, p))]
    return p, y, spark.createDataFrame(data, "label int, probs array<float>, batch int")


def brute(p, y, n):
    at = np.floor(p.astype(np.float64) * (n - 1)).astype(int)
    return {
        c: tuple([int(np.sum((at[:, c] >= i) & ((y == c) == hit))) for i in range(n)] for hit in (True, False))
        for c in range(3)
    }


@pytest.mark.parametrize("n", [2, 11, 200])
def test_counts_and_curve_against_brute_force(spark, n):
    p, y, df = rows(spark)
    counts = G.grid_counts(df, n)
    assert all(len(r["pos"]) == len(r["neg"]) == n for r in counts.collect())
    got = {}
    for r in G.grid_roc(counts).orderBy("threshold").collect():
        tp, fp = got.setdefault(r["class"], ([], []))
        tp.append(r["tp"])
        fp.append(r["fp"])
        assert r["tpr"] == pytest.approx(r["tp"] / np.sum(y == r["class"]))
        assert r["fpr"] == pytest.approx(r["fp"] / np.sum(y != r["class"]))
    assert got == brute(p, y, n)


def test_parts_add_up(spark):
    _, _, df = rows(spark)
    parts = [G.grid_counts(df.where(f"batch % 3 = {i}"), 20) for i in range(3)]
    whole = {r["class"]: (r["pos"], r["neg"]) for r in G.grid_counts(df, 20).collect()}
    assert {r["class"]: (r["pos"], r["neg"]) for r in G.merged_counts(*parts).collect()} == whole


def test_area(spark):
    p, y, df = rows(spark)
    n = 50
    at = np.floor(p.astype(np.float64) * (n - 1)).astype(int)
    for r in G.grid_auroc(G.grid_counts(df, n)).collect():
        pos, neg = at[y == r["class"], r["class"]], at[y != r["class"], r["class"]]
        pairs = (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2
        assert r["auroc"] == pytest.approx(pairs / len(pos) / len(neg))
    _, _, two = rows(spark, labels=2)
    area = {r["class"]: r["auroc"] for r in G.grid_auroc(G.grid_counts(two, n)).collect()}
    assert area[2] is None and area[0] is not None
    assert {r["auroc"] for r in G.grid_auroc(G.grid_counts(two, n), 0.0).where("class = 2").collect()} == {0.0}


def test_batches(spark):
    _, _, df = rows(spark)
    got = {r["batch"]: r["macro_tpr"] for r in G.batch_tpr_at_fpr(df, "batch", 0.2).collect()}
    one = G.batch_tpr_at_fpr(df.where("batch = 2"), "batch", 0.2).first()
    assert len(got) == 6 and got[2] == one["macro_tpr"] and all(0 <= v <= 1 for v in got.values())


def test_odd_scores(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [nan, None]), (None, [0.5, 0.5])], "label int, probs array<float>")
    counts = {r["class"]: (r["pos"], r["neg"]) for r in G.grid_counts(df.where("label is not null"), 3).collect()}
    assert counts == {0: ([0, 0, 1], [0, 0, 0]), 1: ([0, 0, 0], [1, 0, 0])}
    assert G.grid_counts(df.where("false"), 3).collect() == []
