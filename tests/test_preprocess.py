import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raggedly.functions import normalizers as N
from raggedly.operators import preprocess as PP
from raggedly.operators.vectorize import vectorize
from raggedly.plans.layout import raw_layout
from raggedly.plans.spec import EventSpec, ObjectGroup, Treatment
from raggedly.sources.sinks import read_vectors, write_vectors

SPEC = EventSpec(
    (
        ObjectGroup("obj", ("A_B_PT", "A_B_Eta", "A_B_Phi"), 2, count=True),
        ObjectGroup("met", ("A_C_MET",), None),
    )
)
SECTIONS = raw_layout(SPEC)


def fit_values(spark, kind, values, family="other"):
    """Fit one plain column with one normalizer."""
    spec = EventSpec((ObjectGroup("g", ("v",), None),))
    plan = PP.Preprocessor(raw_layout(spec), Treatment(transforms={}, normalizers={"other": kind}))
    df = spark.createDataFrame([([float(v)],) for v in values], "x array<double>")
    model = plan.fit(df)
    return model, [r["x"][0] for r in model.transform(df).collect()]


def test_standard(spark):
    model, y = fit_values(spark, "standard", [0, 1, 2, 4])
    s = model.stats["g.other"]
    assert s["mean"] == pytest.approx(7 / 3)
    assert s["std"] == pytest.approx(np.std([1, 2, 4], ddof=1) + 1e-6)
    assert sorted(y)[1] == 0.0 or 0.0 in y


def test_all_zero_and_single_value(spark):
    for kind, names in (("standard", ("mean", "std")), ("robust", ("median", "iqr"))):
        model, y = fit_values(spark, kind, [0, 0, 0])
        assert [model.stats["g.other"][n] for n in names] == [0.0, 1.0]
        assert y == [0.0] * 3
    model, y = fit_values(spark, "standard", [0, 3])
    assert model.stats["g.other"]["std"] is None
    assert sum(math.isnan(v) for v in y) == 1 and 0.0 in y


def test_robust_and_constant(spark):
    model, _ = fit_values(spark, "robust", [0, 1, 2, 4, 10])
    assert (model.stats["g.other"]["median"], model.stats["g.other"]["iqr"]) == (2.0, 3.75)
    model, _ = fit_values(spark, "robust", [5, 5, 5])
    assert model.stats["g.other"]["iqr"] == 1e-6


def test_minmax_scales_zero(spark):
    model, y = fit_values(spark, "minmax", [0, 2, 4])
    assert (model.stats["g.other"]["min"], model.stats["g.other"]["max"]) == (0.0, 4.0)
    assert sorted(y) == pytest.approx([0, 2 / (4 + 1e-6), 4 / (4 + 1e-6)])
    model, y = fit_values(spark, "minmax", [-2, 0, 2])
    assert 2 / (4 + 1e-6) in [pytest.approx(v) for v in y]


def test_unknown_normalizer():
    with pytest.raises(ValueError, match="unknown normalizer"):
        N.check_normalizer("median")
    with pytest.raises(ValueError, match="unknown normalizer"):
        PP.Preprocessor(SECTIONS, Treatment(normalizers={"pt": "cube"}))


def events(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 5))
        pt, eta, phi = (rng.normal(size=k).tolist() for _ in range(3))
        rows.append((["a", "b"][i % 2], f"f{i % 6}.parquet", ["train", "train", "val"][i % 3], i, pt, eta, phi, float(rng.normal())))
    return spark.createDataFrame(
        rows,
        "class_folder string, file string, split string, row long, A_B_PT array<double>, "
        "A_B_Eta array<double>, A_B_Phi array<double>, A_C_MET double",
    )


def vectors(spark, **kw):
    df = vectorize(events(spark, **kw), SPEC, ["class_folder", "file", "split", "row"])
    return df.withColumn("y", F.when(F.col("class_folder") == "a", 0).otherwise(1).cast("long"))


def reference_fit_apply(x):
    """The same treatment in NumPy, on raw vectors (n, 8)."""
    def log(v):
        return np.where(v != 0, np.sign(v) * np.log1p(np.abs(v) + 1e-6), 0)

    cols, blocks = [], []
    for o in range(2):
        pt, eta, phi = x[:, 3 * o], x[:, 3 * o + 1], x[:, 3 * o + 2]
        cols += [log(pt), eta, np.where(phi != 0, np.sin(phi), 0), np.where(phi != 0, np.cos(phi), 0)]
        blocks += ["pt", "eta", None, None]
    cols += [x[:, 6], log(x[:, 7])]
    blocks += ["count", "met"]
    e = np.stack(cols, 1)
    out = e.copy()
    for b in {b for b in blocks if b}:
        at = [i for i, k in enumerate(blocks) if k == b]
        v = e[:, at].ravel()
        if b == "count":
            out[:, at] = (e[:, at] - v.min()) / (v.max() - v.min() + 1e-6)
        else:
            v = v[v != 0]
            med = np.quantile(v, 0.5, method="lower")
            iqr = max(np.quantile(v, 0.75) - np.quantile(v, 0.25), 1e-6)
            out[:, at] = np.where(e[:, at] != 0, (e[:, at] - med) / iqr, 0)
    return out


def test_whole_treatment_matches_numpy(spark):
    df = vectors(spark)
    rows = df.orderBy("row").collect()
    want = reference_fit_apply(np.array([r["x"] for r in rows]))
    model = PP.Preprocessor(SECTIONS).fit(df)
    got = np.array([r["x"] for r in model.transform(df).orderBy("row").collect()])
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    assert model.n_fit == 60
    state = model.as_dict()
    assert state["_meta"]["num_features_expanded"] == 10
    assert state["block_group_stats"]["obj.phi"] == {}


def test_save_load_and_width_check(spark, tmp_path):
    plan = PP.Preprocessor(SECTIONS)
    model = plan.fit(vectors(spark))
    path = str(tmp_path / "stats")
    model.save(spark, path)
    again = plan.load(spark, path)
    assert again.as_dict() == model.as_dict()
    with pytest.raises(ValueError, match="features"):
        PP.Preprocessor(SECTIONS, Treatment(transforms={})).load(spark, path)
    bad = spark.createDataFrame([([1.0],)], "x array<double>")
    with pytest.raises(Exception, match="width differs"):
        model.transform(bad).collect()
    with pytest.raises(ValueError, match="no rows"):
        plan.fit(vectors(spark).where("false"))


def test_run_modes_and_resume(spark, tmp_path):
    plan = PP.Preprocessor(SECTIONS)
    raw, out, stats = (str(tmp_path / n) for n in ("raw", "out", "stats"))
    write_vectors(vectors(spark), raw)

    def run(**kw):
        return PP.run(spark, plan, raw, out, stats, ["a", "b"], splits=["train", "val"], **kw)

    with pytest.raises(ValueError, match="mode"):
        run(mode="guess")
    with pytest.raises(FileNotFoundError):
        run(enabled=False)
    fitted = run(mode="fit_only", n_files=1)
    sample = PP.fit_sample(read_vectors(spark, raw), ["a", "b"], 1)
    assert {(r["class_folder"], r["file"]) for r in sample.select("class_folder", "file").collect()} == {
        ("a", "f0.parquet"), ("b", "f1.parquet")
    }
    assert fitted.n_fit == sample.count()
    # Part of the work is done already; the rest is added, nothing twice.
    done = read_vectors(spark, raw, split="val")
    PP.apply_files(fitted, read_vectors(spark, raw), done.select("class_folder", "split", "file").distinct(), out)
    assert spark.read.parquet(out).count() == done.count()
    run(mode="apply_only")
    run(mode="apply_only")
    rows = read_vectors(spark, out)
    assert rows.count() == 60 and rows.where("split = 'val'").count() == done.count()
    assert run(enabled=False) is None
    want = {r["row"]: r["x"] for r in fitted.transform(read_vectors(spark, raw)).collect()}
    assert {r["row"]: r["x"] for r in rows.collect()} == want


def test_unmasked_moments(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([2.0, 5.0],)], "x array<double>")
    rows = {r["position"]: r for r in PP.unmasked_moments(df).collect()}
    assert rows[0]["mean"] == 1.0 and rows[0]["std"] == pytest.approx(math.sqrt(2 + 1e-6))
    single = PP.unmasked_moments(df.limit(1)).first()
    assert single["std"] == pytest.approx(1e-3)


def test_wide_layout_stays_compiled(spark):
    """247 raw and 316 expanded features, as one row of plain expressions."""
    from test_layout import EIGHTEEN_CLASSES

    sections = raw_layout(EIGHTEEN_CLASSES)
    x = [float(i % 2) for i in range(247)]
    df = spark.createDataFrame([(x,), ([0.0] * 247,)], "x array<double>")
    plan = PP.Preprocessor(sections)
    model = plan.fit(df)
    out = model.transform(df)
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()
    assert {len(r["x"]) for r in out.collect()} == {316}


def test_positions_need_the_declared_width(spark):
    from raggedly.operators.preprocess import standardize_positions, unmasked_moments

    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([2.0, 4.0, 6.0],)], "x array<double>")
    moments = unmasked_moments(df)
    assert len(standardize_positions(df, moments, 3).first()["x"]) == 3
    with pytest.raises(Exception, match="width differs"):
        standardize_positions(df, moments, 2).collect()
    with pytest.raises(ValueError, match="no moments"):
        standardize_positions(df, moments, 4)


def test_a_fit_takes_the_whole_train_split_by_default(spark):
    from raggedly.operators.preprocess import fit_sample

    rows = [("train" if i % 3 else "val", "c", f"f{i:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "split string, class_folder string, file string")
    assert fit_sample(df, ["c"]).count() == 20 and fit_sample(df, ["c"], 5).count() == 5


@pytest.mark.parametrize("kind", ["standard", "robust", "minmax"])
def test_nan_takes_no_part_in_any_fit(spark, kind):
    nan = float("nan")
    with_nan, _ = fit_values(spark, kind, [0, 1, nan, 2, 4, 10, nan])
    without, _ = fit_values(spark, kind, [0, 1, 2, 4, 10])
    a, b = (m.stats["g.other"] for m in (with_nan, without))
    assert {k: v for k, v in a.items() if isinstance(v, str)} == {k: v for k, v in b.items() if isinstance(v, str)}
    assert [a[k] for k in N.PARAMETERS[kind]] == pytest.approx([b[k] for k in N.PARAMETERS[kind]])
    assert (with_nan.n_left_out, without.n_left_out) == (2, 0)
    assert (with_nan.n_fit, without.n_fit) == (7, 5)
