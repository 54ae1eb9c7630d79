import pytest
from pyspark.sql import functions as F

from raggedly.operators import jobs
from raggedly.operators.preprocess import Preprocessor
from raggedly.operators.vectorize import label_vectors
from raggedly.plans.layout import raw_layout
from raggedly.plans.spec import ClassList, Treatment
from raggedly.sources import events as E
from raggedly.sources import ledger as L
from raggedly.sources import sinks as K
from raggedly.streaming import incremental as I
from tests.test_sources import CLASSES, SPEC, damage_body, shards, write_shard  # noqa: F401

SIG = ClassList(("Signal",), {"Signal": "sig"})


@pytest.fixture()
def ledger(spark, tmp_path):
    return L.Ledger(spark, str(tmp_path / "vectors"))


def manifest_of(spark, *files):
    return spark.createDataFrame(files, "class_folder string, file string, split string")


def state(ledger):
    return {(r["file"], r["split"]): r["n_rows"] for r in ledger.finished().collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_job_takes_each_file_once(spark, shards, ledger, tmp_path):  # noqa: F811
    report = str(tmp_path / "report")
    some = manifest_of(spark, ("sig", "s0.parquet", "train"), ("sig", "s1.parquet", "unused"), ("none", "x", "train"))
    all_ = manifest_of(
        spark, ("sig", "s0.parquet", "train"), ("sig", "s1.parquet", "val"), ("bkg", "b0.parquet", "train"),
        ("bkg", "b1.parquet", "train"), ("bkg", "broken.parquet", "train"), ("sig", "gone.parquet", "val"),
    )
    assert jobs.vectorize_pending(spark, shards, some, CLASSES, SPEC, ledger) == 1
    assert jobs.vectorize_pending(spark, shards, some, CLASSES, SPEC, ledger) == 0
    assert state(ledger) == {("s0.parquet", "train"): 10}
    for n in (3, 0):  # the damaged and the missing one stay pending
        assert jobs.vectorize_pending(spark, shards, all_, CLASSES, SPEC, ledger, report) == n
        assert state(ledger) == {
            ("s0.parquet", "train"): 10, ("s1.parquet", "val"): 20, ("b0.parquet", "train"): 15, ("b1.parquet", "train"): 0,
        }
        assert {r["file"] for r in spark.read.json(report).collect()} == {"broken.parquet", "gone.parquet"}
    assert {r["file"] for r in ledger.pending(all_).collect()} == {"broken.parquet", "gone.parquet"}
    with pytest.raises(Exception):  # without a report they end the job, and nothing is added
        jobs.vectorize_pending(spark, shards, all_, CLASSES, SPEC, ledger)
    write_shard(f"{shards}/bkg/broken.parquet", 6, 500)  # mended
    write_shard(f"{shards}/sig/gone.parquet", 2, 600)
    assert jobs.vectorize_pending(spark, shards, all_, CLASSES, SPEC, ledger, report) == 2
    rows = ledger.vectors()
    got = {(r["file"], r["y"]): r["count"] for r in rows.groupBy("file", "y").count().collect()}
    assert got == {("s0.parquet", 0): 10, ("s1.parquet", 0): 20, ("b0.parquet", 1): 15, ("broken.parquet", 1): 6, ("gone.parquet", 0): 2}
    assert K.read_vectors(spark, f"{ledger.root}/vectors", "val").count() == 22


def test_what_is_finished_is_known_without_a_vector(spark, shards, ledger):  # noqa: F811
    work = manifest_of(spark, ("sig", "s0.parquet", "train"))
    jobs.vectorize_pending(spark, shards, work, CLASSES, SPEC, ledger)
    files = ledger.pending(work).inputFiles()
    assert files and all("/ledger/batch=" in f for f in files)
    assert "x#" not in plan(ledger.pending(work))


def test_batches_without_a_commit_are_not_there(spark, shards, ledger):  # noqa: F811
    rows = label_vectors(E.scan_classes(spark, shards, SIG, SPEC).withColumn("split", F.lit("train")), SPEC)
    assert ledger.vectors().count() == 0 and ledger.finished().count() == 0
    K.write_vectors(rows.where("file = 's2.parquet'"), f"{ledger.root}/vectors/batch=lost")  # no ledger entry
    assert ledger.add("a", rows.where("file = 's0.parquet'"))
    assert not ledger.add("a", rows.where("file = 's1.parquet'"))  # repeated: adds nothing
    assert ledger.vectors().groupBy("file").count().collect() == [("s0.parquet", 10)]
    pruned = plan(ledger.vectors().where("split = 'train'"))
    assert "PartitionFilters" in pruned and "batch#" in pruned.split("PartitionFilters")[1]
    assert ledger.add("lost", rows.where("file = 's1.parquet'"))  # what the lost job left is replaced
    assert {tuple(r) for r in ledger.vectors().groupBy("file").count().collect()} == {("s0.parquet", 10), ("s1.parquet", 20)}
    assert ledger.add("none", rows.where("false"))
    assert ledger.vectors().count() == 30
    with pytest.raises(ValueError):
        ledger.add("a/b", rows)


def test_preprocessing_reads_the_batches_it_needs(spark, shards, ledger, tmp_path):  # noqa: F811
    out = L.Ledger(spark, str(tmp_path / "applied"))
    first = manifest_of(spark, ("sig", "s0.parquet", "train"), ("bkg", "b1.parquet", "val"))
    jobs.vectorize_pending(spark, shards, first, CLASSES, SPEC, ledger)
    prep = Preprocessor(raw_layout(SPEC), Treatment())
    model = prep.fit(ledger.vectors())
    assert jobs.apply_pending(model, ledger, out) == {"n_files": 2, "n": 10, "n_nan": 0, "unknown": []}
    assert jobs.apply_pending(model, ledger, out)["n_files"] == 0
    jobs.vectorize_pending(spark, shards, manifest_of(spark, ("sig", "s1.parquet", "val")), CLASSES, SPEC, ledger)
    assert jobs.apply_pending(model, ledger, out)["n"] == 20
    assert state(out) == {("s0.parquet", "train"): 10, ("b1.parquet", "val"): 0, ("s1.parquet", "val"): 20}
    want = model.transform(ledger.vectors()).select("file", "row", "x")
    assert sorted(map(str, out.vectors().select("file", "row", "x").collect())) == sorted(map(str, want.collect()))


def test_streams_take_each_file_once(spark, shards, ledger, tmp_path):  # noqa: F811
    checkpoint = str(tmp_path / "checkpoint")

    def run(manifest=None):
        stream = I.stream_events(spark, shards, SIG, SPEC, manifest, max_files=1)
        I.incremental_vectorize(stream, SPEC, ledger, checkpoint)
        return ledger.vectors().count()

    assert run() == 60
    assert run() == 60
    assert ledger.finished().select("batch").distinct().count() == 3
    write_shard(f"{shards}/sig/s3.parquet", 7)
    assert run() == 67
    events = E.scan_classes(spark, shards, SIG, SPEC).withColumn("split", F.lit("train"))
    want = label_vectors(events, SPEC).select("file", "row", "x", "y", "split", "class_folder")
    got = K.read_vectors(spark, f"{ledger.root}/vectors").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_stream_with_a_manifest(spark, shards, ledger, tmp_path):  # noqa: F811
    work = manifest_of(spark, ("sig", "s0.parquet", "val"), ("sig", "s1.parquet", "unused"), ("bkg", "b0.parquet", "train"))
    I.incremental_vectorize(
        I.stream_events(spark, shards, SIG, SPEC, work), SPEC, ledger, str(tmp_path / "checkpoint")
    )
    assert state(ledger) == {("s0.parquet", "val"): 10}


def test_a_batch_that_is_repeated_after_a_failure(spark, shards, ledger, tmp_path, monkeypatch):  # noqa: F811
    """The job is lost after the vectors, before the ledger: nobody sees them, and the batch comes again."""
    checkpoint, real = str(tmp_path / "checkpoint"), L.write_vectors

    def lost(*args, **more):
        real(*args, **more)
        raise RuntimeError("lost")

    def run():
        I.incremental_vectorize(I.stream_events(spark, shards, SIG, SPEC), SPEC, ledger, checkpoint)

    monkeypatch.setattr(L, "write_vectors", lost)
    with pytest.raises(Exception, match="lost"):
        run()
    assert ledger.vectors().count() == 0
    monkeypatch.setattr(L, "write_vectors", real)
    run()
    assert ledger.vectors().count() == 60 and state(ledger)["s2.parquet", "train"] == 30


def test_running_counts_are_published(spark, shards, tmp_path):  # noqa: F811
    path, checkpoint = str(tmp_path / "counts"), str(tmp_path / "cp")
    versions = L.Versions(spark, path)
    with pytest.raises(FileNotFoundError):
        versions.current()

    def run():
        I.running_class_counts(I.stream_events(spark, shards, SIG, SPEC), "class_folder", path, checkpoint)
        return [tuple(r) for r in versions.current().collect()]

    assert run() == [("sig", 60)]
    seen = versions.current()
    write_shard(f"{shards}/sig/s3.parquet", 7)
    assert run() == [("sig", 67)]
    assert [tuple(r) for r in seen.collect()] == [("sig", 60)]  # who has begun to read goes on


def test_versions(spark, tmp_path):
    versions = L.Versions(spark, str(tmp_path / "v"), keep=2)
    for n in range(4):
        assert versions.publish(n, spark.range(n + 1))
    assert versions.published() == [2, 3] and versions.current().count() == 4
    assert not versions.publish(3, spark.range(99)) and not versions.publish(0, spark.range(99))
    assert versions.current().count() == 4
    # A version that is written but not published is not read, and is written again.
    spark.range(50).write.parquet(f"{versions.root}/version={4:020d}")
    assert versions.current().count() == 4
    assert versions.publish(4, spark.range(7)) and versions.current().count() == 7


def test_all_unknown_categories_in_one_list(spark, tmp_path):
    from raggedly.plans.spec import EventSpec, ObjectGroup

    spec = EventSpec((ObjectGroup("obj", ("X_A_Charge", "X_A_PT"), 2),))
    rows = [([1.0, 7.0], [2.0, 1.0]), ([-3.9, 0.0], [3.0, 1.0]), ([5.5, 1.0], [float("nan"), 1.0]), ([7.2, -1.0], [4.0, 2.0])]
    data = [(f"f{i}", i, c, p, "train", "sig", 0) for i, (c, p) in enumerate(rows)]
    events = spark.createDataFrame(
        data, "file string, row long, X_A_Charge array<double>, X_A_PT array<double>, split string, class_folder string, label long"
    )
    source = L.Ledger(spark, str(tmp_path / "in"))
    source.add("a", label_vectors(events, spec))
    bad = ["charge=-3.9", "charge=5.5", "charge=7.0", "charge=7.2"]
    for strict in (True, False):
        prep = Preprocessor(raw_layout(spec), Treatment(normalizers={}), strict=strict)
        model = prep.fit(source.vectors())
        out = L.Ledger(spark, str(tmp_path / f"out{strict}"))
        if strict:
            with pytest.raises(ValueError, match=", ".join(bad).replace(".", r"\.")):
                jobs.apply_pending(model, source, out)
            assert out.vectors().count() == 0 and out.finished().count() == 0
        else:
            seen = jobs.apply_pending(model, source, out)
            assert (seen["n_files"], seen["n"], seen["n_nan"], seen["unknown"]) == (4, 4, 1, bad)
            assert out.vectors().count() == 4
