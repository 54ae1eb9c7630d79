import hashlib
import random

import pytest

from raggedly.operators import catalog as C
from raggedly.operators import splits as S


def loop_split(files, targets, seed):
    out = {}
    for folder in {f for f, _, _ in files}:
        items = sorted(
            ((name, n) for f, name, n in files if f == folder),
            key=lambda x: (hashlib.md5(f"{seed}/{x[0]}".encode()).hexdigest(), x[0]),
        )
        at, acc = 0, 0
        for name, n in items:
            if at >= 3:
                out[folder, name] = "unused"
                continue
            out[folder, name] = S.SPLITS[at]
            acc += n
            if acc >= targets[at]:
                at, acc = at + 1, 0
    return out


@pytest.mark.parametrize("case", range(8))
def test_greedy_matches_the_loop(spark, case):
    rng = random.Random(case)
    files = [
        (f"c{c}", f"f{i}", rng.choice([0, 0, 5, 10, 100]))
        for c in range(4) for i in range(rng.choice([1, 3, 20, 60]))
    ]
    targets = rng.choice([(100, 50, 20), (0, 0, 0), (30, 0, 500), (10**6, 1, 1)])
    df = spark.createDataFrame(files, "class_folder string, file string, n_rows long")
    got = {(r["class_folder"], r["file"]): r["split"] for r in S.greedy_split(df, targets, 7).collect()}
    assert got == loop_split(files, targets, 7)


def test_empty_splits_are_listed(spark):
    df = spark.createDataFrame([("a", "f", 5)], "class_folder string, file string, n_rows long")
    rows = S.with_empty_splits(S.greedy_split(df, (100, 1, 1)), ["a", "b"]).collect()
    assert {(r["class_folder"], r["split"]): r["n_files"] for r in rows} == {
        (c, s): int((c, s) == ("a", "train")) for c in "ab" for s in S.SPLITS
    }


def test_ratio_split(spark):
    files = [("a", f"f{i}", 30) for i in range(6)]
    df = spark.createDataFrame(files, "class_folder string, file string, n_rows long")
    rows = {r["file"]: (r["split"], r["take"]) for r in S.ratio_split(df, 0.8, 100).collect()}
    assert rows == {
        "f0": ("train", 30), "f1": ("train", 30), "f2": ("val", 30), "f3": ("val", 10)
    }


def test_chunks_and_ranges(spark):
    files = [("a", "train", f"f{i:03d}") for i in range(120)]
    df = spark.createDataFrame(files, "class_folder string, split string, file string")
    chunks = S.job_chunks(df, ["class_folder", "split", "file"])
    sizes = {r["chunk"]: r["count"] for r in chunks.groupBy("chunk").count().collect()}
    assert sizes == {0: 50, 1: 50, 2: 20}
    manifests = {r["chunk"]: r["files"] for r in S.chunk_manifests(chunks).collect()}
    assert manifests[2] == [f"f{i:03d}" for i in range(100, 120)]
    ranges = S.worker_ranges(df, ["file"], 7).groupBy("worker").count().collect()
    assert {r["worker"]: r["count"] for r in ranges} == {**{w: 18 for w in range(6)}, 6: 12}


def test_manifest_is_reused(spark, tmp_path):
    path = str(tmp_path / "manifest")
    schema = "class_folder string, file string, n_rows long"
    first = S.read_or_create_manifest(spark, path, spark.createDataFrame([("a", "f", 5)], schema), (1, 1, 1))
    assert first.count() == 1
    again = S.read_or_create_manifest(spark, path, spark.createDataFrame([("a", "g", 5)], schema), (1, 1, 1))
    assert [r["file"] for r in again.collect()] == ["f"]


def test_summary_and_coverage(spark):
    manifest = spark.createDataFrame(
        [("a", "train", "f1"), ("a", "val", "f2"), ("x", "train", "f9")],
        "class_folder string, split string, file string",
    )
    catalog = spark.createDataFrame(
        [("a", "f1", 10), ("b", "f3", 5)], "class_folder string, file string, n_rows long"
    )
    rows = {(r["class_folder"], r["split"]): r for r in C.dataset_summary(manifest, catalog).collect()}
    assert ("x", "train") not in rows
    assert rows["a", "val"]["n_missing"] == 1 and rows["a", None]["n_rows"] == 10
    assert rows[None, None]["n_files"] == 2 and rows[None, None]["level"] == 3
    assert [r[0] for r in C.unknown_classes(manifest, catalog).collect()] == ["x"]
    with pytest.raises(Exception, match="no count for a/f2"):
        C.coverage(manifest, catalog, {"train": 1}, ["a"]).collect()
    known = manifest.where("file = 'f1'")
    cover = C.coverage(known, catalog, {"train": 10, "val": 0}, ["a"])
    assert {r["split"]: r["enough"] for r in cover.collect()} == {"train": True, "val": False}
    assert C.has_enough(cover).first()["enough"] is False
    assert C.has_enough(cover.where("split = 'train'")).first()["enough"] is True


def test_greedy_split_counts_the_files_once(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(f"c{i % 3}", f"f{i}", 10 + i % 7) for i in range(90)]
    spark.createDataFrame(rows, "class_folder string, file string, n_rows long").write.parquet(path)
    out = S.greedy_split(spark.read.parquet(path), (100, 50, 20), 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and path not in plan and "md5" not in plan
    assert out.count() == 90
