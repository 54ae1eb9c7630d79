import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from raggedly.session import fresh_folder
from raggedly.workload import jobs


def test_shards_are_named_without_asking_for_each(spark, monkeypatch):
    n, classes = 120, ("1-URGENT", "4-NOT SPECIFIED")
    rows = [(i * jobs.SHARD_ROWS // 2, classes[i % 3 == 0], "old") for i in range(n)]
    events = spark.createDataFrame(rows, "o_orderkey long, class_folder string, file string")
    asked, ask = [], jobs.hadoop_path
    monkeypatch.setattr(jobs, "order_events", lambda spark, sf_dir: events)
    monkeypatch.setattr(jobs, "hadoop_path", lambda *a: asked.append(a) or ask(*a))
    base = jobs.named_shards(spark, "", sort=True)
    assert len(asked) < 10  # not once for each shard
    want = {}
    for key, c, _ in rows:
        want.setdefault((f"class_folder={c}", f"f{key // jobs.SHARD_ROWS}.parquet"), []).append(key)
    got = {
        (c, f): pq.ParquetFile(f"{base}/{c}/{f}").read().column("o_orderkey").to_pylist()
        for c in os.listdir(base) if c != "made"
        for f in os.listdir(f"{base}/{c}") if not f.startswith(".")
    }
    assert got == want


def test_a_shard_in_two_files_is_an_error(spark):
    base = fresh_folder(spark, "shards")
    os.makedirs(f"{base}/made/class_folder=a/shard=f0.parquet")
    for part in ("x", "y"):
        pq.write_table(pa.table({"k": [1]}), f"{base}/made/class_folder=a/shard=f0.parquet/{part}.parquet")
    with pytest.raises(ValueError):
        jobs.named_parts(spark, f"{base}/made", base)
