import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from raggedly.functions.names import label_shard, shard_to_source, source_to_shard, stem
from raggedly.operators import catalog as C
from raggedly.operators.feed import batches, capped_scan, class_cap
from raggedly.operators.profile import distinct_values
from raggedly.operators.splits import greedy_split
from raggedly.operators.vectorize import vectorize
from raggedly.plans.spec import ClassList, EventSpec, ObjectGroup
from raggedly.sources import events as E
from raggedly.sources import sinks as K

SPEC = EventSpec(
    (ObjectGroup("obj", ("pt", "eta"), 2, count=True), ObjectGroup("met", ("met",), None))
)
CLASSES = ClassList(("Signal", "Background"), {"Signal": "sig", "Background": "bkg"})


def write_shard(path, n, start=0, extra=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = {
        "pt": pa.array([[float(i % 3)] * (i % 4) for i in range(start, start + n)], pa.list_(pa.float32())),
        "eta": pa.array([[float(i)] * (i % 4) for i in range(start, start + n)], pa.list_(pa.float32())),
        "met": pa.array([float(i) for i in range(start, start + n)], pa.float32()),
    }
    if extra:
        data["unread"] = pa.array(["x"] * n)
    pq.write_table(pa.table(data), path)


@pytest.fixture()
def shards(tmp_path):
    base = tmp_path / "events"
    for i, n in enumerate((10, 20, 30)):
        write_shard(str(base / "sig" / f"s{i}.parquet"), n, 100 * i, extra=i == 1)
    write_shard(str(base / "bkg" / "b0.parquet"), 15, 1000)
    write_shard(str(base / "bkg" / "b1.parquet"), 0)
    (base / "bkg" / "broken.parquet").write_bytes(b"not parquet at all")
    write_shard(str(base / "bkg" / "footer.parquet"), 5, 2000)
    whole = (base / "bkg" / "footer.parquet").read_bytes()
    size = int.from_bytes(whole[-8:-4], "little")
    (base / "bkg" / "footer.parquet").write_bytes(whole[: -8 - size] + b"\xff" * size + whole[-8:])
    (base / "bkg" / "notes.txt").write_text("skip me")
    return str(base)


def test_catalog_reports_every_file(spark, shards):
    classes = ClassList(("Signal", "Background", "Gone"), {"Signal": "sig", "Background": "bkg", "Gone": "gone"})
    rows = {(r["class_folder"], r["file"]): (r["n_rows"], r["status"]) for r in C.build_catalog(spark, shards, classes).collect()}
    assert rows == {
        ("sig", "s0.parquet"): (10, "ok"),
        ("sig", "s1.parquet"): (20, "ok"),
        ("sig", "s2.parquet"): (30, "ok"),
        ("bkg", "b0.parquet"): (15, "ok"),
        ("bkg", "b1.parquet"): (0, "empty"),
        ("bkg", "broken.parquet"): (0, "unreadable"),
        ("bkg", "footer.parquet"): (0, "unreadable"),
    }
    with pytest.raises(FileNotFoundError):
        C.build_catalog(spark, shards, ClassList(("Gone",), {"Gone": "gone"}))


def test_a_scan_reports_bad_shards_and_goes_on(spark, shards, tmp_path):
    manifest = spark.createDataFrame(
        [("bkg", "train", f) for f in ("b0.parquet", "b1.parquet", "footer.parquet", "broken.parquet")]
        + [("sig", "val", "s1.parquet")],
        "class_folder string, split string, file string",
    )
    report = str(tmp_path / "report")
    rows = E.scan_manifest(spark, shards, manifest, CLASSES, SPEC, report)
    assert rows.groupBy("split").count().orderBy("split").collect() == [("train", 15), ("val", 20)]
    bad = spark.read.json(report).collect()
    assert {r["file"] for r in bad} == {"footer.parquet", "broken.parquet"} and all(r["error"] for r in bad)
    with pytest.raises(Exception):
        E.scan_manifest(spark, shards, manifest, CLASSES, SPEC).count()


def damage_body(path):
    """Pages overwritten in the middle; the footer stays."""
    data = bytearray(open(path, "rb").read())
    pages = len(data) - int.from_bytes(data[-8:-4], "little") - 8
    data[pages // 4 : 3 * pages // 4] = b"\xa5" * (3 * pages // 4 - pages // 4)
    with open(path, "wb") as file:
        file.write(data)


def bad_of(report):
    return {(r["file"], r["n_rows"]): r["error"] for r in report.collect()}


def test_a_shard_with_a_damaged_body_goes_as_a_whole(spark, shards, tmp_path):
    write_shard(f"{shards}/sig/body.parquet", 5000, 10_000)
    damage_body(f"{shards}/sig/body.parquet")
    names = ("s0.parquet", "body.parquet", "gone.parquet")
    manifest = spark.createDataFrame(
        [("sig", "train", f) for f in names] + [("bkg", "val", "b1.parquet"), ("bkg", "val", "b0.parquet")],
        "class_folder string, split string, file string",
    )
    catalog = {r["file"]: r["status"] for r in C.build_catalog(spark, shards, CLASSES).collect()}
    assert catalog["body.parquet"] == "ok"  # the footer is
    report = str(tmp_path / "report")
    rows = E.scan_manifest(spark, shards, manifest, CLASSES, SPEC, report)
    assert rows.groupBy("file").count().orderBy("file").collect() == [("b0.parquet", 15), ("s0.parquet", 10)]
    bad = bad_of(spark.read.json(report))
    assert set(bad) == {("body.parquet", 5000), ("gone.parquet", None)}
    assert "5000 rows" in bad["body.parquet", 5000] and bad["gone.parquet", None] == "no such file"
    with pytest.raises(Exception):
        E.scan_files(spark, shards, [("sig", "body.parquet")], CLASSES, SPEC).agg(F.sum("met")).collect()


def test_only_declared_columns_are_decoded(spark, tmp_path):
    """Damage in a column that nobody reads leaves a shard good."""
    path = str(tmp_path / "sig" / "a.parquet")
    write_shard(path, 3000, extra=True)
    group = pq.ParquetFile(path).metadata.row_group(0)
    chunk = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "unread")
    data = bytearray(open(path, "rb").read())
    first = chunk.dictionary_page_offset or chunk.data_page_offset
    data[first : first + chunk.total_compressed_size] = b"\x00" * chunk.total_compressed_size
    with open(path, "wb") as file:
        file.write(data)
    files = spark.createDataFrame([("sig", "a.parquet")], "class_folder string, file string")
    good = E.check_files(spark, str(tmp_path), files, SPEC).first()
    assert (good["n_rows"], good["n_found"], good["error"]) == (3000, 3000, None)
    assert E.check_files(spark, str(tmp_path), files).first()["error"]


def test_nothing_is_there(spark, shards):
    files = spark.createDataFrame([("none", "a.parquet"), ("sig", "b.parquet")], "class_folder string, file string")
    rows = E.check_files(spark, shards, files, SPEC).collect()
    assert [r["error"] for r in rows] == ["no such file"] * 2
    with pytest.raises(Exception):  # an unknown file system is no fault of a shard
        E.check_files(spark, "nosuch://store/x", files, SPEC).collect()


def test_a_path_that_only_spark_opens(spark, shards, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.events.link./in", f"file://{shards}")
    base = "viewfs://events/in"
    catalog = {(r["class_folder"], r["file"]): (r["n_rows"], r["status"]) for r in C.build_catalog(spark, base, CLASSES).collect()}
    assert catalog == {(r["class_folder"], r["file"]): (r["n_rows"], r["status"]) for r in C.build_catalog(spark, shards, CLASSES).collect()}
    manifest = spark.createDataFrame(
        [("bkg", "train", f) for f in ("b0.parquet", "b1.parquet", "footer.parquet", "broken.parquet")]
        + [("sig", "val", "s1.parquet")],
        "class_folder string, split string, file string",
    )
    report = str(tmp_path / "report")
    rows = E.scan_manifest(spark, base, manifest, CLASSES, SPEC, report)
    assert rows.groupBy("split").count().orderBy("split").collect() == [("train", 15), ("val", 20)]
    assert {f for f, _ in bad_of(spark.read.json(report))} == {"footer.parquet", "broken.parquet"}
    stats = C.class_stats(spark, base, ClassList(("Signal",), {"Signal": "sig"}), "met float")
    assert [tuple(r) for r in stats.collect()] == [("sig", 60, 0.0, 229.0)]


def test_stats_come_from_footers(spark, shards):
    from raggedly.sources import footers

    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    write_shard(f"{shards}/sig/s9.parquet", 4, 900)
    rest = ",".join(s for s in before.split(",") if s != "parquet")
    with footers.settings(spark, sources__useV1SourceList=rest, parquet__aggregatePushdown="true"):
        plan = footers.pushed_counts(spark, [f"{shards}/sig"])._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    one = ClassList(("Signal", "Gone"), {"Signal": "sig", "Gone": "gone"})
    assert [tuple(r) for r in C.class_stats(spark, shards, one).collect()] == [("sig", 64)]
    # A file whose columns stand in another order has its own place for each.
    pq.write_table(pa.table({"unread": [5.0], "met": pa.array([-3.0], pa.float32())}), f"{shards}/sig/other.parquet")
    assert [tuple(r) for r in C.class_stats(spark, shards, one, "met float").collect()] == [("sig", 65, -3.0, 903.0)]
    with pytest.raises(FileNotFoundError):
        C.class_stats(spark, shards, ClassList(("Gone",), {"Gone": "gone"}), "met float")


def test_names_with_blanks_and_signs(spark, tmp_path):
    folder = "4-NOT +5% é"
    write_shard(str(tmp_path / folder / "a b+1.parquet"), 3)
    write_shard(str(tmp_path / folder / "{x}[1]*.parquet"), 2)
    write_shard(str(tmp_path / folder / "x1.parquet"), 7)
    classes = ClassList(("x",), {"x": folder})
    found = C.build_catalog(spark, str(tmp_path), classes).orderBy("n_rows").collect()
    assert [tuple(r)[:3] for r in found] == [
        (folder, "{x}[1]*.parquet", 2), (folder, "a b+1.parquet", 3), (folder, "x1.parquet", 7)
    ]
    odd = E.scan_files(spark, str(tmp_path), [(folder, "{x}[1]*.parquet")], classes, SPEC)
    assert odd.count() == 2
    files = spark.createDataFrame([(folder, r["file"]) for r in found], "class_folder string, file string")
    assert E.check_files(spark, str(tmp_path), files, SPEC).where("error is null").count() == 3
    rows = E.scan_files(spark, str(tmp_path), [(folder, "a b+1.parquet")], classes, SPEC).collect()
    assert {(r["class_folder"], r["file"]) for r in rows} == {(folder, "a b+1.parquet")} and len(rows) == 3


def test_scan_reads_only_what_is_listed(spark, shards):
    df = E.scan(spark, f"{shards}/sig", schema=E.spec_schema(SPEC))
    assert df.columns == SPEC.columns and df.count() == 60
    plan = df.select("met")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<met:float>" in plan
    one = ClassList(("Signal",), {"Signal": "sig"})
    rows = E.scan_classes(spark, shards, one, SPEC)
    assert rows.groupBy("file", "label").count().count() == 3
    assert rows.where("file = 's2.parquet'").agg(F.max("row")).first()[0] == 29
    assert E.scan(spark, shards, ["met"], recursive=True, skip_corrupt=True).count() == 75


def test_manifest_scan_opens_its_files_only(spark, shards):
    catalog = C.build_catalog(spark, shards, CLASSES).where("status = 'ok'")
    manifest = greedy_split(catalog, (15, 10, 5), 1)
    rows = E.scan_manifest(spark, shards, manifest, CLASSES, SPEC)
    got = {(r["class_folder"], r["file"], r["split"]): r["count"] for r in rows.groupBy("class_folder", "file", "split").count().collect()}
    want = {(r["class_folder"], r["file"], r["split"]): r["n_rows"] for r in manifest.where("split <> 'unused'").collect()}
    assert got == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("cap", [5, 10, 35, 1000])
def test_capped_scan_is_exact(spark, shards, cap):
    catalog = C.build_catalog(spark, shards, CLASSES).where("status = 'ok'")
    rows = capped_scan(spark, shards, CLASSES, catalog, cap, SPEC)
    got = {r["class_folder"]: r["count"] for r in rows.groupBy("class_folder").count().collect()}
    assert got == {"sig": min(cap, 60), "bkg": min(cap, 15)}
    assert rows.select("file", "row").distinct().count() == rows.count()


def test_class_cap_and_batches(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 700, "hot").otherwise("cold"))
    capped = class_cap(df, "c", [F.col("id")], 400, n_classes=2)
    assert {r["c"]: r["count"] for r in capped.groupBy("c").count().collect()} == {"hot": 400, "cold": 300}
    assert {r["id"] for r in capped.collect()} == {r["id"] for r in class_cap(df.repartition(7), "c", [F.col("id")], 400).collect()}
    sizes = batches(df, [F.col("id")], 128).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [104] + [128] * 7
    assert batches(df, [F.col("id")], 128, drop_last=True).count() == 896


def test_vector_sink_and_pending(spark, shards, tmp_path):
    out = str(tmp_path / "vectors")
    assert K.written_files(spark, out).count() == 0
    catalog = C.build_catalog(spark, shards, CLASSES).where("status = 'ok'")
    manifest = greedy_split(catalog, (10, 10, 10), 1).where("split <> 'unused'")
    rows = E.scan_manifest(spark, shards, manifest, CLASSES, SPEC)
    vectors = vectorize(rows, SPEC, ["file", "row", "label", "split", "class_folder"]).withColumnRenamed("label", "y")
    K.write_vectors(vectors.where("class_folder = 'bkg'"), out)
    todo = K.pending(manifest.select("class_folder", "split", "file"), K.written_files(spark, out))
    assert {r["class_folder"] for r in todo.collect()} == {"sig"}
    K.write_vectors(vectors.join(todo, ["class_folder", "split", "file"], "left_semi"), out)
    stored = K.read_vectors(spark, out)
    assert stored.count() == rows.count()
    pruned = K.read_vectors(spark, out, "train", ["sig"])
    assert "PartitionFilters: [isnotnull(split" in pruned._jdf.queryExecution().executedPlan().toString()
    gaps = K.missing_outputs(spark, out, ["sig", "bkg"], ["train", "val"]).collect()
    assert {(r["split"], r["class_folder"]) for r in gaps} == {("val", "bkg")}


def test_distinct_values_and_sinks(spark, shards, tmp_path):
    df = E.scan(spark, f"{shards}/sig")
    found = distinct_values(df, "pt")
    K.write_distinct(found, str(tmp_path / "json"))
    K.write_distinct(found, str(tmp_path / "csv"), "csv")
    assert [r["pt"] for r in spark.read.json(str(tmp_path / "json")).collect()] == [0.0, 1.0, 2.0]
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 3


def test_file_name_maps(spark):
    df = spark.createDataFrame([("d/run-1.2.parquet", "a_x.npy")], "p string, s string")
    r = df.select(
        stem(F.col("p")), source_to_shard(F.col("p")), shard_to_source(F.col("s")), label_shard(F.col("s"))
    ).first()
    assert list(r) == ["run-1.2", "d/run-1.2_x.npy", "a.parquet", "a_y.npy"]


def test_class_list_errors():
    with pytest.raises(ValueError, match="without a folder"):
        ClassList(("a",), {"b": "c"})
    with pytest.raises(ValueError, match="unique"):
        ClassList(("a", "a"))
