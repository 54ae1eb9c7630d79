import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from raggedly.functions.scoring import argmax, cross_entropy, softmax
from raggedly.operators import metrics as M
from raggedly.operators import runs as R
from raggedly.operators.mlp import mlp_score
from raggedly.operators.profile import histogram
from raggedly.sources.sinks import write_predictions


def scored_rows(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, probs array<float>")


def random_scores(n=80, classes=3, seed=0):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        p = [rng.choice([0.0, 0.125, 0.25, 0.5, 0.75, 1.0]) for _ in range(classes)]
        rows.append((rng.randrange(classes), p.index(max(p)), p))
    return rows


def test_auroc_is_pair_counting(spark):
    rows = random_scores()
    got = {r["class"]: r["auroc"] for r in M.auroc(scored_rows(spark, rows)).collect()}
    for c in range(3):
        pos = [p[c] for y, _, p in rows if y == c]
        neg = [p[c] for y, _, p in rows if y != c]
        pairs = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
        assert got[c] == pytest.approx(pairs / len(pos) / len(neg))


def test_class_without_positives(spark):
    rows = [(0, 0, [0.5, 0.25]), (0, 1, [0.25, 0.5])]
    got = {r["class"]: r["auroc"] for r in M.auroc(scored_rows(spark, rows)).collect()}
    assert got == {0: None, 1: None}
    zero = M.auroc(scored_rows(spark, rows), empty=0.0).collect()
    assert {r["auroc"] for r in zero} == {0.0}


def test_roc_and_interpolation(spark):
    rows = random_scores(200, seed=5)
    curve = M.roc(scored_rows(spark, rows))
    points = M.with_start(curve).collect()
    for target in (0.01, 0.2, 0.7, 1.0):
        got = {r["class"]: r["tpr"] for r in M.tpr_at_fpr(curve, target).collect()}
        for c in range(3):
            xy = sorted((r["fpr"], r["tpr"]) for r in points if r["class"] == c)
            assert xy[0] == (0.0, 0.0) and xy[-1] == (1.0, 1.0)
            want = np.interp(target, [x for x, _ in xy], [y for _, y in xy])
            assert got[c] == pytest.approx(want)


def test_f1_and_accuracy(spark):
    rows = random_scores(60, seed=2)
    df = scored_rows(spark, rows)
    f1 = []
    for c in sorted({y for y, _, _ in rows} | {p for _, p, _ in rows}):
        tp = sum(y == c and p == c for y, p, _ in rows)
        wrong = sum((y == c) != (p == c) for y, p, _ in rows)
        f1.append(2 * tp / (2 * tp + wrong))
    assert M.macro_f1(df).first()[0] == pytest.approx(np.mean(f1))
    assert M.accuracy(df).first()["accuracy"] == pytest.approx(np.mean([y == p for y, p, _ in rows]))


def test_scoring_functions(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 1001.0], 2)], "z array<float>, y int")
    r = df.select(softmax(F.col("z")), argmax(F.col("z")), cross_entropy(F.col("z"), F.col("y"))).first()
    e = math.exp(-1)
    assert r[0] == pytest.approx([e / (2 + e), 1 / (2 + e), 1 / (2 + e)])
    assert r[1] == 1 and r[2] == pytest.approx(-math.log(1 / (2 + e)))


def test_evaluator_and_export(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, [2.0, 1.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (0, None)], "label int, logits array<double>"
    )
    values = {r["name"]: r["value"] for r in M.Evaluator(df, ["a", "b"]).summary().collect()}
    assert values["acc"] == pytest.approx(2 / 3) and set(values) == {
        "class_a_auc", "class_b_auc", "loss", "acc", "f1", "mean_auc", "tpr_macro"
    }
    metrics = spark.createDataFrame(list(values.items()), "name string, value double")
    assert M.metric(metrics, "acc") == values["acc"]
    with pytest.raises(KeyError):
        M.metric(metrics, "nothing")
    path = str(tmp_path / "predictions")
    write_predictions(df, path, ["a", "b"])
    stored = spark.read.parquet(path)
    assert stored.count() == 3 and stored.first()["class_names"] == ["a", "b"]


def test_mlp_matches_numpy(spark):
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(5, 4)), rng.normal(size=5)), (rng.normal(size=(3, 5)), rng.normal(size=3))]
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, x array<double>")
    got = np.array([r["logits"] for r in mlp_score(df, layers).orderBy("i").collect()])
    want = np.maximum(x @ layers[0][0].T + layers[0][1], 0) @ layers[1][0].T + layers[1][1]
    np.testing.assert_allclose(got, want)


def test_histogram_edges(spark):
    rng = random.Random(0)
    values = [round(rng.gauss(0, 2), 3) for _ in range(300)]
    rows = [("a", v) for v in values] + [("flat", 3.0)] * 4
    df = spark.createDataFrame(rows, "feature string, value double")
    got = histogram(df, 10, groups=2).collect()
    counts = [0] * 10
    for r in got:
        if r["feature"] == "a":
            counts[r["bin"]] = r["n"]
    assert counts == np.histogram(values, bins=10)[0].tolist()
    assert [(r["bin"], r["n"]) for r in got if r["feature"] == "flat"] == [(5, 4)]


def test_runs(spark):
    df = spark.createDataFrame(
        [("r1", 2, 0.5), ("r1", 1, 0.7), ("r1", 3, 0.7), ("r2", 1, 0.9), ("q", 1, 0.1)],
        "run_name string, ts int, val_acc double",
    )
    best = {(r["run_name"], r["ts"]): r["best"] for r in R.running_best(df, "run_name", ["ts"], "val_acc").collect()}
    assert best == {("r1", 1): 0.7, ("r1", 2): 0.7, ("r1", 3): 0.7, ("r2", 1): 0.9, ("q", 1): 0.1}
    epochs = {(r["run_name"], r["ts"]): r["epoch"] for r in R.epoch_index(df, "run_name", ["ts"]).collect()}
    assert epochs["r1", 3] == 2 and epochs["r2", 1] == 0
    first = {r["run_name"]: r["ts"] for r in R.best_epoch(df, "run_name", "val_acc", F.col("ts"), ["ts"]).collect()}
    assert first == {"r1": 1, "r2": 1, "q": 1}
    last = {r["run_name"]: r["val_acc"] for r in R.last_epoch(df, "run_name", F.col("ts"), ["val_acc"]).collect()}
    assert last["r1"] == 0.7
    assert R.name_like(df, "r%").count() == 4
    labels = {r["run_name"]: r["label"] for r in R.labelled(df, {"r1": "One"}).collect()}
    assert labels == {"r1": "One", "r2": None, "q": None}
    assert [r["run_name"] for r in R.group_best(df, "run_name", "val_acc").collect()] == ["r2", "r1", "q"]
    a = spark.createDataFrame([("acc", 1.0), ("loss", 2.0)], "name string, value double")
    b = spark.createDataFrame([("acc", 3.0)], "name string, value double")
    assert {r["name"]: r["value"] for r in R.merged_metrics(a, b).collect()} == {"acc": 3.0, "loss": 2.0}


def test_pivot_rejects_an_undeclared_value(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "i int, c string, v double")
    row = R.pivot_max(df, "i", "c", "v", ["a", "b"]).first()
    assert (row["a"], row["b"]) == (2.0, 3.0)
    with pytest.raises(Exception, match="not declared: b"):
        R.pivot_max(df, "i", "c", "v", ["a"]).collect()


def test_equal_trials_have_one_order(spark):
    rows = [(3, 0.5), (1, 0.5), (2, 0.9), (4, 0.9)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "number int, value double")
        assert R.best_trial(df, ["number"]).first()["number"] == 4
        ranks = {r["number"]: r["rank"] for r in R.trials_by_value(df, ["number"]).collect()}
        assert ranks == {2: 1, 4: 2, 1: 3, 3: 4}


def test_summary_reads_predictions_twice(spark, tmp_path):
    rows = [(i % 3, [float(i % 5), float(i % 7), 1.0]) for i in range(60)] + [(1, None)]
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, "label int, logits array<double>").write.parquet(path)
    summary = M.Evaluator(spark.read.parquet(path), ["a", "b", "c"]).summary()
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert path not in plan and "logits" not in plan  # everything comes from the stored counts
    assert {r["name"] for r in summary.collect()} >= {"loss", "acc", "f1", "mean_auc", "tpr_macro", "class_a_auc"}
