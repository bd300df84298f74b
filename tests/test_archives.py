"""The recording data source and the commit log of the collecting stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.sources import archives as A
from sensorframe.streaming import incremental


@pytest.fixture()
def root(tmp_path):
    for split, rec, n in (("train", "a", 70), ("train", "b", 5), ("test", "c", 11)):
        g = np.random.default_rng(n)
        A.write_archive(str(tmp_path), split, rec, {"imu": g.normal(size=(n, 6)), "ts": np.arange(n) / 200, "fs": np.array(200.0)})
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.npz").write_bytes(b"not an archive")
    return str(tmp_path)


def counts(df):
    return {(r.split, r.rec): r["count"] for r in df.groupBy("split", "rec").count().collect()}


def test_only_asked_archives_are_opened(spark, root):
    assert counts(A.read_archives(spark, root, "train")) == {("train", "a"): 70, ("train", "b"): 5}
    assert counts(A.read_archives(spark, root, "train,test", ["b", "c"])) == {("train", "b"): 5, ("test", "c"): 11}
    assert A.read_archives(spark, root, "absent").count() == 0
    with pytest.raises(Exception, match="pickle|zip|magic|file"):
        A.read_archives(spark, root).count()
    row = A.read_archives(spark, root, "test").where("frame = 10").first()
    assert (row.ts, row.qw) == (10 / 200, None) and row.wz == np.random.default_rng(11).normal(size=(11, 6))[10, 5]


def test_filters_reach_the_listing(spark, root):
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        df = A.read_archives(spark, root)
        assert counts(df.where("split = 'train'")) == {("train", "a"): 70, ("train", "b"): 5}
        assert counts(df.where("rec IN ('a', 'c') AND frame < 3")) == {("train", "a"): 3, ("test", "c"): 3}
    finally:
        spark.conf.unset(key)


def test_partitions_follow_sizes(root):
    found = A.listed(root, {"split": {"train", "test"}})
    assert [a.rec for a in found] == ["c", "a", "b"]
    assert [len(p.archives) for p in A.dealt(found, 1)] == [1, 1, 1]
    assert [len(p.archives) for p in A.dealt(found, 1 << 30)] == [3] and A.dealt([], 5) == []


def test_stream_reads_each_archive_once(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def run():
        q = (A.follow_archives(spark, root, "train").select("rec").writeStream.format("parquet").option("path", f"{out}/rows")
             .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
        q.awaitTermination()
        return {r.rec: r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("rec").count().collect()}
    assert run() == {"a": 70, "b": 5}
    A.write_archive(root, "train", "d", {"imu": np.zeros((4, 6))})
    assert run() == {"a": 70, "b": 5, "d": 4} and run() == {"a": 70, "b": 5, "d": 4}


def test_replayed_batches_count_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def put(tag, n):
        (folder / f"tag={tag}").mkdir(parents=True)
        (folder / f"tag={tag}" / "p.csv").write_text("window_id,vx,vy,vz\n" + "".join(f"w{i},1,2,3\n" for i in range(n)))

    def run(hook=None):
        q = incremental.collect_once(spark, f"{folder}/*", str(tmp_path / "seen"), out, {"": "all"},
                                     lambda b: b.groupBy("tag").agg(F.count("*").alias("n")), r"tag=([^/]+)/", before_commit=hook)
        q.awaitTermination()

    def fail(batch_id):
        raise RuntimeError("stop")
    put("one", 7)
    for _ in range(2):
        with pytest.raises(Exception):
            run(fail)
    run()
    put("two", 3)
    run()
    run()
    assert sorted(map(tuple, incremental.committed(spark, out).select("tag", "n").collect())) == [("one", 7), ("two", 3)]
    assert spark.read.option("basePath", f"{out}/results").parquet(f"{out}/results").count() == 4  # two broken attempts lie beside
