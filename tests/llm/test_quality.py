import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raggedly.llm import quality as Q


def toy(n=900, seed=0):
    r = np.random.default_rng(seed)
    texts, grades = [], []
    for i in range(n):
        grade = i % 3
        words = [f"w{x}" for x in r.integers(0, 400, 40)]
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        if grade == 1:
            words[int(r.integers(0, 40))] = f"badro{r.integers(0, 9)}"
        texts.append(" ".join(words))
        grades.append(grade)
    return texts, grades


def test_gradient_is_the_slope():
    rng = np.random.default_rng(2)
    score, grades, free = rng.normal(size=30), rng.integers(0, 4, 30), rng.normal(size=3)

    def loss(s, f):
        edges = np.concatenate([[-np.inf], Q._ordered(f), [np.inf]])
        cdf = lambda x: 1 / (1 + np.exp(-x))
        return -np.log(cdf(edges[grades + 1] - s) - cdf(edges[grades] - s)).sum()

    g_score, g_free = Q._gradient(score, grades, free)
    h = 1e-6
    for i in range(30):
        d = np.eye(30)[i] * h
        assert (loss(score + d, free) - loss(score - d, free)) / (2 * h) == pytest.approx(g_score[i], abs=1e-4)
    for i in range(3):
        d = np.eye(3)[i] * h
        assert (loss(score, free + d) - loss(score, free - d)) / (2 * h) == pytest.approx(g_free[i], abs=1e-3)


def test_scores_are_the_sum_of_features():
    weights = np.random.default_rng(1).normal(size=Q.BUCKETS)
    texts = pa.array(["a b a A, ab", "", "é É\n(x) 12 12 12", "long " * 3000, "  "])
    made = Q.features(texts)
    ends = np.cumsum(made.counts)
    want = [weights[made.buckets[a:b]].sum() for a, b in zip(ends - made.counts, ends)]
    assert Q.scores(texts, weights) == pytest.approx(want)
    assert len(Q.scores(pa.array([], pa.string()), weights)) == 0


def test_held_out_accuracy(make, spark):
    texts, grades = toy()
    docs = make(list(enumerate(texts)))
    labels = spark.createDataFrame(
        [(i, g) for i, g in enumerate(grades) if i < 600] + [(5, None), (None, 1), (99999, 2)], "doc_id long, grade int"
    )
    model = Q.train(docs, labels, F.col("grade"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in Q.grade_documents(docs, model, least_tail=0.5).collect()}
    right = [out[i].kept == (grades[i] == 2) for i in range(600, 900)]
    assert np.mean(right) > 0.97
    mean = [np.mean([out[i].expected_grade for i in range(600, 900) if grades[i] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    again = Q.train(docs, labels, F.col("grade"), 3)
    assert (again.weights == model.weights).all() and (again.thresholds == model.thresholds).all()


@pytest.mark.parametrize("n", [0, 200, 900])
def test_grades_by_brute_force(make, spark, n):
    """Every document's grade from the sum of its features' weights, one text at a time."""
    texts, grades = toy(max(n, 3), seed=4)
    labels = spark.createDataFrame(list(enumerate(grades[:n])), "doc_id long, grade int")
    model = Q.train(make(list(enumerate(texts))), labels, F.col("grade"), 3)
    rows = [*enumerate(texts), (10**6, "unseen words only"), (10**6 + 1, None)]
    got = {r.doc_id: r for r in Q.grade_documents(make(rows), model).collect()}
    for i, text in rows:
        score = sum(model.weights[b] for b in Q.features(pa.array([text or ""])).buckets.tolist())
        tails = 1 / (1 + np.exp(-(score - model.thresholds)))
        assert got[i].tail == pytest.approx(tails[-1], rel=1e-4)
        assert got[i].expected_grade == pytest.approx(tails.sum(), rel=1e-4)
        assert got[i].kept == (not model.weights.any() or got[i].tail >= Q.LEAST_TAIL)


def test_odd_rows(make, spark):
    texts, grades = toy(90)
    labels = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    docs = make(list(enumerate(texts)))
    model = Q.train(docs, labels, F.col("grade"), 3)
    odd = make([(None, None), (1, ""), (2, "x " * 20000), (2, "x " * 20000), (3, "\n")])
    got = Q.grade_documents(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.expected_grade <= 2 for r in got)
    assert Q.grade_documents(make([]), model).collect() == []


def test_without_labels_every_grade_is_as_likely(make, spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = Q.train(make([(1, "a b")]), none, F.col("grade"), 3)
    row = Q.grade_documents(make([(1, "a b")]), model).first()
    assert row.expected_grade == pytest.approx(1.0) and row.kept
