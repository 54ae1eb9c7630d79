import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from raggedly.functions.ordering import float_bucket, shuffle_bucket, shuffle_key
from raggedly.operators.prefix import first_n, order_statistics, running


def skewed(n=3000, seed=0):
    """A third of all rows and more in one group; one group is null."""
    rng = random.Random(seed)
    groups = ["hot"] * 5 + ["a", "b", None]
    return [(rng.choice(groups), i, rng.randint(-5, 5), rng.gauss(0, 10)) for i in range(n)]


SCHEMA = "g string, id long, v long, x double"


def brute(rows, key):
    sums, best, out = {}, {}, {}
    for g, i, v, x in sorted(rows, key=key):
        sums[g] = sums.get(g, 0) + v
        best[g] = max(best.get(g, x), x)
        out[i] = (sums[g], best[g])
    return out


@pytest.mark.parametrize("how", ["sampled", "float", "hash"])
def test_running_matches_a_loop(spark, how):
    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if how == "sampled":
        out = running(df, ["g"], ["id"], None, {"s": F.col("v")}, {"m": F.col("x")}, totals=True)
        want = brute(rows, lambda r: r[1])
    elif how == "float":
        out = running(df, ["g"], ["x", "id"], float_bucket(F.col("x"), 4), {"s": F.col("v")}, {"m": F.col("x")}, totals=True)
        want = brute(rows, lambda r: (r[3], r[1]))
    else:
        import hashlib

        df = df.withColumn("h", shuffle_key(1, F.col("id")))
        out = running(df, ["g"], ["h"], shuffle_bucket(F.col("h"), 2), {"s": F.col("v")}, {"m": F.col("x")}, totals=True)
        want = brute(rows, lambda r: hashlib.md5(f"1/{r[1]}".encode()).hexdigest())
    got = out.collect()
    assert len(got) == len(rows)
    assert {r["id"]: (r["s"], r["m"]) for r in got} == want
    totals = {}
    for g, _, v, _ in rows:
        totals[g] = totals.get(g, 0) + v
    assert all(r["s_total"] == totals[r["g"]] for r in got)


def test_sampled_cuts_spread_a_hot_group(spark):
    from raggedly.operators.prefix import with_sampled_bucket

    df = spark.range(20000).withColumn("g", F.lit("hot"))
    sizes = [
        r["count"]
        for r in with_sampled_bucket(df, F.struct("g", "id"), 64).groupBy("_bucket").count().collect()
    ]
    assert len(sizes) > 30 and max(sizes) < 20000 * 0.15


def test_running_without_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert running(df, ["g"], ["id"], None, {"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("n", [1, 10, 400, 5000])
def test_first_n_is_exact(spark, n):
    import hashlib

    rows = skewed()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", shuffle_key(1, F.col("id")))
    got = first_n(df, ["g"], ["h"], shuffle_bucket(F.col("h"), 2), n, groups=4).collect()
    want = {}
    for r in sorted(rows, key=lambda r: hashlib.md5(f"1/{r[1]}".encode()).hexdigest()):
        if len(want.setdefault(r[0], [])) < n:
            want[r[0]].append(r[1])
    have = {}
    for r in got:
        have.setdefault(r["g"], set()).add(r["id"])
    assert have == {g: set(ids) for g, ids in want.items()}


def test_float_bucket_keeps_order(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, 2.0, 0.5, -1.0, 1e-300, -1e-300, 5e-324, 1e308, float("inf"), float("-inf"), float("nan")]
    for e in range(-60, 60):
        values += [2.0**e, float(np.nextafter(2.0**e, 0)), float(np.nextafter(2.0**e, 1e308))]
    values += [rng.gauss(0, 1) * 10 ** rng.randint(-9, 9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    rows = df.select("x", float_bucket(F.col("x"), 16).alias("b")).orderBy("x").collect()
    buckets = [r["b"] for r in rows]
    assert None not in buckets and buckets == sorted(buckets)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_order_statistics_match_numpy(spark, n):
    rng = random.Random(n)
    rows = [("a", round(rng.gauss(0, 3), 1)) for _ in range(n)] + [("b", 4.0)] * 7 + [(None, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = order_statistics(
        df, ["g"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, lower=["q50"], pieces=(4, 64), groups=3
    ).collect()
    for r in got:
        v = np.array([x for g, x in rows if g == r["g"]])
        assert r["q25"] == pytest.approx(np.quantile(v, 0.25))
        assert r["q75"] == pytest.approx(np.quantile(v, 0.75))
        assert r["q50"] == np.quantile(v, 0.5, method="lower")
    assert len(got) == 3


def test_worked_quartiles(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "v double").withColumn("g", F.lit(0))
    r = order_statistics(df, ["g"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, lower=["q50"]).first()
    assert (r["q25"], r["q50"], r["q75"]) == (1.75, 2.0, 5.5)
