import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raggedly.operators import feed
from raggedly.sources import events as E
from raggedly.streaming.cap import _trimmed, append_capped
from raggedly.streaming.incremental import stream_files
from tests.test_sources import CLASSES, SPEC, shards, write_shard  # noqa: F401


def draw(seed, worker, what):
    return int(hashlib.md5(f"{seed}/{worker}/{what}".encode()).hexdigest()[:8], 16)


def brute(rows, size, seed, worker):
    """The buffer row by row."""
    slots, out = [], []
    for t, row in enumerate(rows):
        if len(slots) < size:
            slots.append(row)
        else:
            s = draw(seed, worker, t) % size
            out.append(slots[s])
            slots[s] = row
    return out + [slots[s] for s in sorted(range(len(slots)), key=lambda s: (draw(seed, worker, f"end/{s}"), s))]


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
@pytest.mark.parametrize("step", [1, 3, 64])
def test_a_buffer_of_any_size_in_any_batches(size, step):
    n = 200
    worker = np.repeat([4, 5], [150, 50])
    whole = pa.RecordBatch.from_pydict({"v": np.arange(n), "worker": worker})
    parts = [whole.slice(i, step) for i in range(0, n, step)] + [whole.slice(0, 0)]
    got = pa.Table.from_batches(list(feed._through_buffer(size, 9)(parts))).to_pydict()
    want = brute(range(150), size, 9, 4) + brute(range(150, 200), size, 9, 5)
    assert got["v"] == want
    assert got["position"] == [*range(150), *range(50)]
    assert list(feed._through_buffer(size, 9)([])) == []


def test_the_buffer_holds_a_bounded_number_of_rows():
    buffer = feed._Buffer(10, 1, 0)
    for i in range(100):
        list(buffer.take(pa.RecordBatch.from_pydict({"v": np.arange(5) + 5 * i, "worker": [0] * 5})))
        assert buffer.held.num_rows <= 2 * 10 + 2 * 5


@pytest.mark.parametrize("workers", [1, 2, 9])
def test_shards_through_the_buffer(spark, shards, workers):  # noqa: F811
    names = [("sig", f"s{i}.parquet") for i in range(3)] + [("bkg", "b0.parquet"), ("bkg", "b1.parquet"), ("x", "y")]
    files = spark.createDataFrame(names, "class_folder string, file string")
    rows = feed.buffer_shuffle(spark, shards, files, CLASSES, workers, SPEC, buffer_rows=8, seed=3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "partitioning(" not in plan and "Sort" not in plan  # no row is moved
    got = {}
    for r in rows.collect():
        got.setdefault(r["worker"], {})[r["position"]] = r["met"]
    order = sorted(names[:5], key=lambda n: hashlib.md5(f"3/{n[0]}/{n[1]}".encode()).hexdigest())
    content = {
        (r["class_folder"], r["file"]): [] for r in files.collect()
    }
    for r in E.scan_files(spark, shards, names[:5], CLASSES, SPEC).orderBy("file", "row").collect():
        content[r["class_folder"], r["file"]].append(r["met"])
    share = -(-5 // workers)
    for w in range(0, -(-5 // share)):
        mine = [v for n in order[w * share : (w + 1) * share] for v in content[n]]
        want = brute(mine, 8, 3, w)
        assert [v for _, v in sorted(got.get(w, {}).items())] == want
    with pytest.raises(ValueError):
        feed.buffer_shuffle(spark, shards, files.where("class_folder = 'x'"), CLASSES, 2, SPEC)


def test_many_files_through_the_buffer_by_one_scan(spark, tmp_path, monkeypatch):
    base, names = str(tmp_path), [("sig", f"s {i}%.parquet") for i in range(34)] + [("bkg", f"s {i}%.parquet") for i in range(6)]
    for i, (c, f) in enumerate(names):
        write_shard(f"{base}/{c}/{f}", 0 if i == 5 else 3 + i % 7, 100 * i)
    names.append(names[0])  # a name that comes twice is read twice
    files = spark.createDataFrame(names, "class_folder string, file string")

    def shuffled(workers):
        rows = feed.buffer_shuffle(spark, base, files, CLASSES, workers, SPEC, buffer_rows=8, seed=3)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        taken = rows.select("worker", "position", "class_folder", "file", "row", "label", "met", "pt").collect()
        return rows.schema, plan.count("parquet"), [tuple(r) for r in taken]

    for workers in (6, 50):
        schema, scans, got = shuffled(workers)
        assert scans == 1
        assert len(got) == len(set(r[:2] for r in got)) == sum(3 + i % 7 for i in [*range(40), 0] if i != 5)
        by_worker = {w: [r[1] for r in got if r[0] == w] for w in {r[0] for r in got}}
        assert all(p == list(range(len(p))) for p in by_worker.values())  # as they come out
        if workers == 50:
            continue
        with monkeypatch.context() as one_by_one:
            one_by_one.setattr(feed, "MOST_SCANS", len(names))
            old_schema, old_scans, want = shuffled(workers)
        assert old_scans == len(names) and [f.dataType for f in schema] == [f.dataType for f in old_schema]
        assert schema.names == old_schema.names and sorted(got, key=str) == sorted(want, key=str)


def test_a_cap_over_batches_and_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "c string, k long, l array<double>"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(source)

    def run(max_files=None):
        append_capped(stream_files(spark, source, schema, max_files), "c", 5, ["k"], out, checkpoint)
        return sorted(((r["c"] or "", r["k"], r["l"]) for r in spark.read.schema(schema).parquet(out).collect()))

    arrive([("a", k, [k / 2] * k) for k in (9, 3, 1)] + [("b", k, None) for k in range(20)] + [(None, 7, [])])
    first = run()
    assert [(c, k) for c, k, _ in first] == [("", 7), ("a", 1), ("a", 3), ("a", 9)] + [("b", k) for k in range(5)]
    assert run() == first
    arrive([("a", k, [1.0]) for k in (8, 2, 4)] + [("b", -1, None), (None, 1, None)])
    second = run()
    assert [(c, k) for c, k, _ in second] == [
        ("", 1), ("", 7), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 9)] + [("b", k) for k in range(5)]
    for i in range(4):
        arrive([("a", 100 + i, None), ("d", i, None), ("d", -i, None)])
    third = run(max_files=1)
    assert sum(c == "a" for c, _, _ in third) == 5 and sum(c == "d" for c, _, _ in third) == 5
    assert len(third) == len(second) + 5


def test_a_task_hands_on_no_more_than_the_cap():
    rows = pa.table({"c": ["a", None, "a", "b", "a", None], "k": [3, 1, 1, 5, 2, 0], "v": [[1.0]] * 6})
    got = _trimmed(rows, "c", 2, ["k"]).select(["c", "k"]).to_pydict()
    assert sorted(zip(map(str, got["c"]), got["k"])) == [("None", 0), ("None", 1), ("a", 1), ("a", 2), ("b", 5)]
