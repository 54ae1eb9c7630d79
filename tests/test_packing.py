import math
import random

import pytest
from pyspark.sql import functions as F

from raggedly.functions import packing as P
from raggedly.operators.vectorize import nest_objects, tokens, vectorize
from raggedly.plans.layout import raw_layout
from raggedly.plans.spec import EventSpec, ObjectGroup

SPEC = EventSpec(
    (
        ObjectGroup("obj", ("pt", "eta"), 3, count=True),
        ObjectGroup("lead", ("pt", "eta"), 1),
        ObjectGroup("scalar", ("met",), None),
    )
)
SCHEMA = "id int, pt array<double>, eta array<double>, met double"


def vectors(spark, rows, spec=SPEC, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r["x"] for r in vectorize(df, spec, ["id"], **kw).collect()}


def test_empty_short_long_ties_and_nulls(spark):
    out = vectors(
        spark,
        [
            (0, [], [], None),
            (1, [5.0], [0.5], 1.5),
            (2, [1.0, 9.0, 3.0, 7.0], [0.1, 0.9, 0.3, 0.7], 2.0),
            (3, [2.0, 2.0, 2.0, 2.0], [1.0, 2.0, 3.0, 4.0], 0.0),
            (4, None, None, 1.0),
        ],
    )
    assert out[0] == [0.0] * 10
    assert out[1] == [5.0, 0.5, 0, 0, 0, 0, 1, 5.0, 0.5, 1.5]
    assert out[2] == [9.0, 0.9, 7.0, 0.7, 3.0, 0.3, 4, 9.0, 0.9, 2.0]
    assert out[3] == [2.0, 1.0, 2.0, 2.0, 2.0, 3.0, 4, 2.0, 1.0, 0.0]
    assert out[4] == [0.0] * 9 + [1.0]


def test_fill_value_and_float32(spark):
    rows = [(0, [0.1], [None], None)]
    assert vectors(spark, rows, fill=-1.0)[0] == [0.1, -1, -1, -1, -1, -1, 1, 0.1, -1, -1]
    narrow = vectors(spark, rows, strict_float32=True)[0]
    assert narrow[0] != 0.1 and abs(narrow[0] - 0.1) < 1e-7


def test_nan_and_null_keys_rank_last(spark):
    nan = float("nan")
    out = vectors(spark, [(0, [nan, 1.0, None, 4.0], [1.0, 2.0, 3.0, 4.0], 0.0)])[0]
    assert out[:4] == [4.0, 4.0, 1.0, 2.0]
    assert math.isnan(out[4]) and out[5] == 1.0
    only = vectors(spark, [(0, [nan], [7.0], 0.0)])[0]
    assert math.isnan(only[0]) and only[1] == 7.0 and only[8] == 7.0


def test_unequal_lengths_fail(spark):
    with pytest.raises(Exception, match="unequal length"):
        vectors(spark, [(0, [1.0, 2.0], [1.0], 0.0)])


def test_matches_a_plain_sort(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        n = rng.choice([0, 1, 2, 3, 4, 40])
        rows.append((i, [float(rng.randint(0, 6)) for _ in range(n)], [rng.random() for _ in range(n)], 1.0))
    out = vectors(spark, rows)
    for i, pt, eta, _ in rows:
        order = sorted(range(len(pt)), key=lambda j: -pt[j])  # stable
        want = [v for j in order[:3] for v in (pt[j], eta[j])]
        want += [0.0] * (6 - len(want)) + [len(pt)]
        want += [pt[order[0]], eta[order[0]]] if order else [0.0, 0.0]
        assert out[i][:9] == want


def test_spec_validation(spark):
    with pytest.raises(ValueError, match="no object count"):
        ObjectGroup("s", ("a",), None, count=True)
    with pytest.raises(ValueError, match="not in the input"):
        vectorize(spark.createDataFrame([(1,)], "id int"), SPEC)
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, pt double, eta double, met double")
    with pytest.raises(ValueError, match="column 'pt' is double"):
        vectorize(df, SPEC)


def test_tokens(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [3.0, 4.0], 5.0)], SCHEMA)
    rows = tokens(vectorize(df, SPEC, ["id"]), raw_layout(SPEC), ["id"]).orderBy("token").collect()
    assert [(r["group"], r["object"], r["values"]) for r in rows] == [
        ("event", 0, [2.0]),
        ("obj", 0, [2.0, 4.0]),
        ("obj", 1, [1.0, 3.0]),
        ("obj", 2, [0.0, 0.0]),
        ("lead", 0, [2.0, 4.0]),
        ("scalar", 0, [5.0]),
    ]
    no_count = EventSpec((ObjectGroup("scalar", ("met",), None),))
    first = tokens(vectorize(df, no_count), raw_layout(no_count), []).orderBy("token").first()
    assert first["values"] == [0.0]


def test_nest_keeps_hot_key_small(spark):
    """One key with most rows: same result, and the rank limit runs before the shuffle."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"),
        (F.col("id") % 101).cast("double").alias("v"), "id",
    )
    nested = nest_objects(df, "k", {"pt": F.col("v"), "n": F.col("id")}, 4)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
    hot = nested.where("k = -1").first()
    want = sorted(((i % 101, -i) for i in range(5000) if i % 3), reverse=True)[:4]
    assert list(zip(hot["pt"], hot["n"])) == [(float(v), -i) for v, i in want]
    assert hot["n_objects"] == sum(1 for i in range(5000) if i % 3)


def test_first_of_list(spark):
    df = spark.createDataFrame([([3.0, 1.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(P.first_of_list(F.col("v"))).collect()] == [3.0, None, None]
