"""Incremental runs read only what changed."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources.incremental import Incremental


def put(spark, path, k, *values):
    spark.createDataFrame([(k, v) for v in values], "k int, v int").toPandas().to_parquet(path / f"f{k:02d}.parquet")


def test_reruns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(20):
        put(spark, tmp_path / "in", k, k, k + 100)
    seen = []

    def process(rows):
        seen.append(rows.select("_file").distinct().count())
        return rows.withColumn("w", F.col("v") * 2).drop("v")

    job = Incremental(spark, str(tmp_path / "out"))
    state = lambda: sorted((r.k, r.w) for r in job.outputs().collect())
    pairs = lambda *ks: sorted((k, w) for k in ks for w in (2 * k, 2 * k + 200))
    assert job.outputs() is None
    assert job.run(str(tmp_path / "in"), {"n": 1}, process) == {"processed": 20, "kept": 0, "retracted": 0}
    assert state() == pairs(*range(20))
    assert job.run(str(tmp_path / "in"), {"n": 1}, process) == {"processed": 0, "kept": 20, "retracted": 0} and seen == [20]
    # One changed file of twenty; one touched without a change.
    put(spark, tmp_path / "in", 3, 7)
    os.utime(tmp_path / "in" / "f05.parquet")
    assert job.run(str(tmp_path / "in"), {"n": 1}, process) == {"processed": 1, "kept": 19, "retracted": 0} and seen == [20, 1]
    assert state() == sorted([*pairs(*[k for k in range(20) if k != 3]), (3, 14)])
    # A removed file is retracted without processing; other settings process all.
    os.remove(tmp_path / "in" / "f00.parquet")
    assert job.run(str(tmp_path / "in"), {"n": 1}, process) == {"processed": 0, "kept": 19, "retracted": 1} and seen == [20, 1]
    assert (0, 0) not in state() and (3, 14) in state()
    # A run that fails leaves the last one.
    put(spark, tmp_path / "in", 4, 9)

    def broken(rows):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        job.run(str(tmp_path / "in"), {"n": 1}, broken)
    assert (4, 8) in state()
    assert job.run(str(tmp_path / "in"), {"n": 2}, process) == {"processed": 19, "kept": 0, "retracted": 0} and seen == [20, 1, 19]
    assert (4, 18) in state() and (4, 8) not in state()
