import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raggedly.llm import topk


def brute(rows, k, every):
    whole = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in whole:
        if i % every == 0:
            found = sorted(
                (-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i and len(c) == len(q)
            )
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16_384, 2_048, 512), (64, 4, 8)])
@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_against_brute_force(spark, monkeypatch, blocks, spread):
    for name, n in zip(("BLOCK_ROWS", "BLOCK_QUERIES", "BUCKET_ROWS"), blocks):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(400):
        v = base[i % 12] + 0.2 * rng.normal(size=8)
        rows.append((i, (v / np.linalg.norm(v) * math.exp(spread * rng.normal())).tolist()))
    rows += [(i, rows[20][1]) for i in range(400, 440)]  # ties
    rows += [(440, None), (441, []), (442, [1.0] * 7 + [None]), (443, [float("nan")] * 8)]
    rows += [(444, [float("inf")] * 8), (None, [1.0] * 8), (450, [0.0] * 8), (460, [1.0] * 3), (470, [-1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_v", F.lit("x"))
    got = topk.top_products(df, F.col("_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)


def test_pruned_vectors_cannot_qualify():
    rng = np.random.default_rng(4)
    c = np.floor(256 * rng.normal(size=(300, 6)))
    q = c[7] + 3
    score = c @ q
    bound = np.sort(score)[-5]
    keep = topk._by_coordinates(
        q, np.linalg.norm(q), np.argsort(-abs(q))[:4], c, np.linalg.norm(c, axis=1), bound
    )
    assert set(np.flatnonzero(score >= bound)) <= set(np.flatnonzero(keep)) and keep.sum() < 150


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**22 + 1 / 256, 1.0]), (1, [2.0**22, 3.0]), (2, [2.0**22 + 1 / 256, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_products(df, F.col("_id") == 0).collect())) == [
        r for r in brute(rows, 5, 1) if r[0] == 0
    ]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_products(df, F.col("_id") % 50 == 0).collect() == []
