"""The committed sink and the stream of files with states."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import filestate

SCHEMA = "id long, name string, v array<float>, m struct<a:int,b:timestamp>"


def rows(spark, n, at=0):
    return spark.range(at, at + n).select("id", F.concat(F.lit("n"), "id").alias("name"), F.array(F.col("id").cast("float")).alias("v"), F.struct(F.col("id").cast("int").alias("a"), F.timestamp_seconds("id").alias("b")).alias("m"))


def test_committed(spark, tmp_path):
    filestate.register(spark)
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        filestate.committed_rows(spark, path)
    put = lambda df, mode="append": df.write.format("committed").option("rows", 30).mode(mode).save(path)
    put(rows(spark, 100).repartition(4))
    put(rows(spark, 50, 100).where("id % 2 = 0"))
    want = sorted(r.id for r in rows(spark, 100).unionByName(rows(spark, 50, 100).where("id % 2 = 0")).collect())
    got = filestate.committed_rows(spark, path)
    assert sorted(r.id for r in got.collect()) == want and dict(got.dtypes) == dict(rows(spark, 1).dtypes)
    parts = set(os.listdir(tmp_path / "t" / "_parts"))

    # A task that fails after it wrote rows: nothing is published, nothing stays.
    bad = rows(spark, 400).repartition(4).withColumn("name", F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        put(bad)
    assert set(os.listdir(tmp_path / "t" / "_parts")) == parts and filestate.committed_rows(spark, path).count() == len(want)

    # A twin of a task: its part is on disk, in no manifest, and deleted at commit.
    writer = filestate._Writer(path, rows(spark, 1).schema, False, "snappy", 10)
    batches = rows(spark, 5, 1000).toArrow().to_batches()
    one, twin = writer.write(iter(batches)), writer.write(iter(batches))
    assert one.name != twin.name and filestate.committed_rows(spark, path).count() == len(want)
    writer.commit([one, None])
    assert filestate.committed_rows(spark, path).count() == len(want) + 5 and not os.path.exists(tmp_path / "t" / "_parts" / twin.name)

    # A write that died before its commit stays invisible; vacuum takes what it left.
    filestate._Writer(path, rows(spark, 1).schema, False, "snappy", 10).write(iter(batches))
    assert filestate.committed_rows(spark, path).count() == len(want) + 5 and filestate.vacuum(path) == 1
    put(rows(spark, 3), "overwrite")
    assert filestate.committed_rows(spark, path).count() == 3 and filestate.vacuum(path) >= 3 and filestate.committed_rows(spark, path).count() == 3
    put(rows(spark, 3).where("false"))
    assert filestate.committed_rows(spark, path).count() == 3


def states(path):
    return sorted(n for n in os.listdir(path) if filestate.state_of(n))


def test_file_queue(spark, tmp_path):
    filestate.register(spark)
    at = tmp_path / "q"
    at.mkdir()
    for k in range(5):
        rows(spark, 10, k * 10).select("id", "name").toPandas().to_parquet(at / f"f{k}.pending.parquet")
        os.utime(at / f"f{k}.pending.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    (at / "note.txt").write_text("not a queue file")
    feed = spark.readStream.format("filequeue").schema("id long, name string").option("files", 2).load(str(at))
    seen, crash = [], [True]

    def take(batch, batch_id):
        got = sorted(r.id for r in batch.collect())
        if crash and crash.pop():
            raise RuntimeError("stop here")
        seen.append((batch_id, got))

    def run():
        q = feed.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="stop here"):
        run()
    assert states(at)[:2] == ["f0.processing.parquet", "f1.processing.parquet"]
    # Another file that was taken without a claim: a crash in between.
    os.rename(at / "f4.pending.parquet", at / "f4.processing.parquet")
    for _ in range(6):
        run()
    ids = [i for _, got in seen for i in got]
    assert sorted(ids) == list(range(50)) and len(seen) >= 3 and seen[0][1] == list(range(20))
    assert sum("completed" in n for n in states(at)) >= 3 and not any("pending" in n for n in states(at))


def test_file_queue_failed_files(spark, tmp_path):
    filestate.register(spark)
    at = tmp_path / "q"
    at.mkdir()
    (at / "a.pending.jsonl").write_text('{"id": 1, "name": "x", "more": 2}\n{"id": 2}\n')
    (at / "b.pending.parquet").write_text("broken")
    for mode in ("fail", "skip"):
        feed = spark.readStream.format("filequeue").schema("id long, name string").option("onError", mode).load(str(at))
        q = feed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        if mode == "fail":
            with pytest.raises(Exception):
                q.awaitTermination(120)
        else:
            q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "x"), (2, None)]
    assert "b.failed.parquet" in states(at)
