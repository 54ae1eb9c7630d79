import math

import pytest
from pyspark.sql import functions as F

from raggedly.functions import transforms as T
from raggedly.plans.layout import raw_layout
from raggedly.plans.spec import EventSpec, ObjectGroup, Treatment


def one(spark, value, build, kind="double"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(build(F.col("x"))).first()[0]


def test_zero_stays_zero(spark):
    assert one(spark, 0.0, T.log1p_signed) == 0.0
    assert one(spark, 0.0, lambda x: F.array(*T.trig_phi(x))) == [0.0, 0.0]
    assert one(spark, None, T.log1p_signed) == 0.0


def test_signed_log(spark):
    assert one(spark, -3.0, T.log1p_signed) == pytest.approx(-math.log1p(3 + 1e-6))


def test_one_hot(spark):
    cats = (-3, 0, 7)
    assert one(spark, -3.7, lambda x: T.one_hot(x, cats)) == [1.0, 0.0, 0.0]
    assert one(spark, 7.9, lambda x: T.one_hot(x, cats)) == [0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="outside the categories"):
        one(spark, 5.0, lambda x: T.one_hot(x, cats))
    assert one(spark, 5.0, lambda x: T.one_hot(x, cats, strict=False)) == [0.0, 0.0, 0.0]
    assert one(spark, float("nan"), lambda x: T.one_hot(x, cats, strict=False)) == [0.0] * 3


def test_unknown_category_report(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.5, 2.0, 2.9, -1.0)], "x double")
    rows = df.where(T.unknown_categories(F.col("x"), (-1, 0, 1))).collect()
    assert sorted(r["x"] for r in rows) == [2.0, 2.9]


def test_registry(spark):
    with pytest.raises(ValueError, match="unknown transform"):
        T.TRANSFORMS.apply("cube", F.lit(1.0), "pt", Treatment())
    with pytest.raises(ValueError, match="no category list"):
        T.TRANSFORMS.apply("onehot", F.lit(1.0), "pt", Treatment())
    T.TRANSFORMS.register("twice", lambda x: x * 2)
    spec = EventSpec((ObjectGroup("g", ("A_B_PT", "A_B_Eta"), 2, count=True),))
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 9.0],)], "x array<double>")
    out = df.select(
        T.expand_vector(F.col("x"), raw_layout(spec), Treatment(transforms={"pt": "twice"}))
    ).first()[0]
    assert out == [2.0, 2.0, 6.0, 4.0, 9.0]


def test_expand_order(spark):
    spec = EventSpec((ObjectGroup("g", ("A_B_Charge", "A_B_Phi", "A_B_Eta"), 2, count=True),))
    df = spark.createDataFrame([([1.0, 0.5, 3.0, 0.0, 0.0, 0.0, 4.0],)], "x array<double>")
    out = df.select(T.expand_vector(F.col("x"), raw_layout(spec), Treatment())).first()[0]
    assert out == pytest.approx(
        [0, 0, 1, math.sin(0.5), math.cos(0.5), 3.0, 0, 1, 0, 0, 0, 0, 4.0]
    )
