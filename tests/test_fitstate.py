import numpy as np
import pytest
from pyspark.sql import functions as F

from raggedly.operators.fitstate import FitState
from raggedly.operators.preprocess import FRACTIONS, Preprocessor
from raggedly.plans.layout import raw_layout
from raggedly.plans.spec import EventSpec, ObjectGroup, Treatment

SPEC = EventSpec((ObjectGroup("g", ("A_B_PT", "A_B_Eta"), 3), ObjectGroup("h", ("A_C_MET",), None)))
KINDS = Treatment(transforms={}, normalizers={"pt": "robust", "eta": "standard", "met": "minmax"})


def plan():
    return Preprocessor(raw_layout(SPEC), KINDS)


def vectors(spark, n, seed, nan=0):
    rng = np.random.default_rng(seed)
    x = rng.lognormal(0, 3, (n, 7)).astype(np.float32) * rng.choice([-1, 0, 1, 1], (n, 7))
    x[rng.random((n, 7)) < 0.1] = 2.5  # ties
    x = x.astype(float)
    x[:nan, 0] = np.nan
    return x, spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")


def close(a, b):
    assert a.keys() == b.keys()
    for block in a:
        for name in a[block]:
            got, want = a[block][name], b[block][name]
            assert got == want if isinstance(want, (str, type(None))) else got == pytest.approx(want, rel=1e-9)


def test_merged_states_equal_one_shot_and_exact_fits(spark, tmp_path):
    parts = [vectors(spark, n, seed, nan) for n, seed, nan in ((300, 1, 3), (50, 2, 0), (0, 3, 0))]
    all_ = parts[0][1].unionByName(parts[1][1])
    whole = FitState.of(plan(), all_)
    first = str(tmp_path / "first")
    FitState.of(plan(), parts[0][1]).save(first)
    merged = FitState.load(spark, plan(), first).merged(*[FitState.of(plan(), p) for _, p in parts[1:]])

    def bins(state):
        return {(r["block"], r["bucket"]): r for r in state.bins.collect()}

    a, b = bins(whole), bins(merged)
    assert a.keys() == b.keys()
    for k in a:
        for c in ("n", "lo", "hi"):
            assert a[k][c] == b[k][c] or a[k][c] != a[k][c]
        assert a[k]["mean"] == pytest.approx(b[k]["mean"], nan_ok=True)
    assert merged.n_vectors() == 350 and merged.n_left_out() == 3
    exact = plan().fit(all_)
    assert (exact.n_fit, exact.n_left_out) == (350, 3)
    close(merged.model(all_).stats, exact.stats)
    # Standard and min-max need no values again.
    rough = merged.model().stats
    for block in ("g.eta", "h.met"):
        close({block: rough[block]}, {block: exact.stats[block]})


def test_bounds_of_the_rank_error(spark):
    x, df = vectors(spark, 2000, 7)
    state = FitState.of(plan(), df)
    values = np.sort(x[:, [0, 2, 4]][x[:, [0, 2, 4]] != 0])
    block = plan().blocks.index("g.pt")
    rows = {r["q"]: r for r in state.quantile_bounds().where(F.col("block") == block).collect()}
    for q, share in FRACTIONS.items():
        true = np.quantile(values, share, method="lower" if q == "q50" else "linear")
        r = rows[q]
        assert r["lo"] <= true <= r["hi"] and r["lo"] <= r["estimate"] <= r["hi"]
        between = np.sum((values > min(true, r["estimate"])) & (values < max(true, r["estimate"])))
        assert between <= r["rank_error"]
        assert r["rank_error"] < len(values) / 3  # the ties; other buckets are narrow
        assert r["estimate"] == pytest.approx(true, rel=1 / 128)


def test_states_without_values(spark):
    empty = spark.createDataFrame([], "x array<double>")
    with pytest.raises(ValueError, match="no rows"):
        FitState.of(plan(), empty).model()
    zeros = spark.createDataFrame([([0.0] * 7,)], "x array<double>")
    close(FitState.of(plan(), zeros).model(zeros).stats, plan().fit(zeros).stats)
    none = Preprocessor(raw_layout(SPEC), Treatment(transforms={}, normalizers={"pt": "none", "eta": "none", "met": "none"}))
    assert FitState.of(none, zeros).model().n_fit == none.fit(zeros).n_fit == 1
    one = spark.createDataFrame([([3.0] + [0.0] * 6,)], "x array<double>")
    close(FitState.of(plan(), one).model(one).stats, plan().fit(one).stats)
