"""Stateful streams: count-or-idle batches across restarts, and the durable queue through crashes."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import queue as plans
from tessera.operators.store import VectorTable
from tessera.streaming import batches, durable, ingest

T0 = datetime(2024, 3, 1)
EVENT = "id long, grp string, ts timestamp_ntz, note string"


def rows(spark, items):
    return spark.createDataFrame([(i, g, T0 + timedelta(seconds=s), f"n{i}") for i, (g, s) in enumerate(items)], EVENT)


def drain(df, out, checkpoint, start=lambda w: w.trigger(availableNow=True).start()):
    q = start(df.writeStream.format("parquet").outputMode("append").option("path", str(out)).option("checkpointLocation", str(checkpoint)))
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive
    return q


@pytest.mark.parametrize("grouped", [True, False])
def test_live_batches_across_restarts(spark, tmp_path, grouped):
    """Rows in several files and three runs give the batch plan's batches."""
    import random

    r = random.Random(4)
    seconds, items = 0, []
    for _ in range(120):
        seconds += r.choice([0, 1, 2, 29, 30, 31, 90])
        items.append((r.choice("ab"), seconds))
    whole = rows(spark, items)
    groups = ["grp"] if grouped else []
    want = {tuple(x) for x in ingest.idle_batches(whole, "ts", "30 seconds", 4, groups, ["id"]).select("id", "session", "chunk").collect()}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = batches.live_batches(stream, "ts", "30 seconds", 4, groups, ["id"], late="20 minutes")
    for k in range(3):
        # Inside a file rows are in disorder.
        for half in range(2):
            whole.where(F.col("id").between(k * 40 + half * 20, k * 40 + half * 20 + 19)).orderBy(F.rand(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(found, tmp_path / "out", tmp_path / "check")
    rows(spark, [("a", 10_000_000), ("b", 10_000_000)]).withColumn("id", F.lit(-1).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(found, tmp_path / "out", tmp_path / "check")
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("id", "session", "chunk").collect() if x["id"] >= 0]
    assert len(got) == len(set(got)) == 120 and set(got) == want
    full = spark.read.parquet(str(tmp_path / "out")).where("id >= 0").groupBy(*groups, "session", "chunk", "reason").count().collect()
    assert all((x["count"] == 4) == (x["reason"] == "count") for x in full)


def test_live_batches_by_arrival(spark, tmp_path):
    """Processing time: full batches at once, the rest after the idle gap."""
    rows(spark, [("a", 0)] * 7).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    found = batches.live_batches(stream, "ts", "3 seconds", 3, ["grp"], ["id"], live=True)
    q = found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        seen = []
        for _ in range(60):
            time.sleep(1)
            seen = spark.read.schema(found.schema).parquet(str(tmp_path / "out")).groupBy("chunk", "reason").count().orderBy("chunk").collect() if (tmp_path / "out").exists() else []
            if len(seen) == 3:
                break
    finally:
        q.stop()
    assert [tuple(x) for x in seen] == [(0, "count", 3), (1, "count", 3), (2, "idle", 1)]


class Crash(RuntimeError):
    pass


def put(spark, path, *events):
    durable.put(spark.createDataFrame([(k, T0 + timedelta(seconds=s), kind, a, p, e) for k, s, kind, a, p, e in events], durable.EVENT).coalesce(1), path)


def states(spark, checkpoint):
    return {r["key"]: (r["status"], r["retry_count"], r["attempt"], r["error_message"]) for r in durable.items(spark, checkpoint).collect()}


def test_queue_states(spark, tmp_path):
    """Every transition, read back by the state data source; answers of other attempts change nothing."""
    path, check = str(tmp_path / "q"), str(tmp_path / "c")
    put(spark, path, *[(k, 0, "enqueue", None, f"p-{k}", None) for k in "abcde"], (None, 0, "enqueue", None, "x", None), ("", 0, "enqueue", None, "x", None))
    events = spark.readStream.schema(durable.EVENT).parquet(path)
    found = durable.transitions(events, base_s=3600, lease_s=3600)

    def run():
        drain(found, tmp_path / "out", check, durable.drained)

    run()
    assert states(spark, check) == {k: ("processing", 0, 1, None) for k in "abcde"}
    put(spark, path, ("a", 1, "ack", 1, None, None), ("b", 1, "fail", 1, None, "lost"), ("c", 1, "ack", 7, None, None), ("d", 1, "enqueue", None, "p2", None), ("zz", 1, "ack", 1, None, None))
    run()
    assert states(spark, check) == {"b": ("pending", 1, 1, "lost"), "c": ("processing", 0, 1, None), "d": ("processing", 0, 2, None), "e": ("processing", 0, 1, None)}
    put(spark, path, ("d", 2, "ack", 1, None, None), ("e", 2, "enqueue", None, "p3", None), ("e", 3, "ack", 2, None, None))
    run()
    assert set(states(spark, check)) == {"b", "c", "d"}
    counts = plans.status_counts(durable.items(spark, check)).first()
    assert tuple(counts) == (1, 2, 0) and plans.health(plans.status_counts(durable.items(spark, check))).first()["healthy"]
    out = sorted((r["key"], r["attempt"], r["payload"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [("a", 1, "p-a"), ("b", 1, "p-b"), ("c", 1, "p-c"), ("d", 1, "p-d"), ("d", 2, "p2"), ("e", 1, "p-e"), ("e", 2, "p3")]


def test_queue_fails_and_retries(spark, tmp_path):
    """Failures come back after their delay, four failures make a failed item, a manual retry starts anew."""
    path, check = str(tmp_path / "q"), str(tmp_path / "c")
    put(spark, path, ("k", 0, "enqueue", None, "p", None))
    tried = []

    def broken(out):
        tried.extend(r["attempt"] for r in out.collect())
        return out.select("key", "attempt", F.lit(False).alias("ok"), F.lit("no").alias("error"))

    q = durable.work(spark, path, check, broken, interval="300 milliseconds", base_s=0.2, lease_s=600)
    try:
        for _ in range(120):
            time.sleep(0.5)
            if states_or_none(spark, check).get("k", ("",))[0] == "failed":
                break
    finally:
        q.stop()
    assert states(spark, check) == {"k": ("failed", 3, 4, "no")} and tried == [1, 2, 3, 4]
    assert durable.retry_failed(spark, check, path) == 1

    def good(out):
        return out.select("key", "attempt", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    for _ in range(2):  # the hand-out, then its ack
        q = durable.work(spark, path, check, good, base_s=0.2, lease_s=600)
        q.awaitTermination(120)
    assert states(spark, check) == {}


def states_or_none(spark, check):
    try:
        return states(spark, check)
    except Exception:  # noqa: BLE001  no batch is committed yet
        return {}


def test_queue_crashes(spark, tmp_path):
    """A crash inside the handler, and one after the work but before its acks: nothing lost, nothing stored twice."""
    path, check = str(tmp_path / "q"), str(tmp_path / "c")
    store = VectorTable(spark, str(tmp_path / "t"), 2)
    durable.enqueue(spark.createDataFrame([(f"k{i}", f"{i}") for i in range(20)], "key string, payload string"), path)
    calls = []

    def handler(out):
        calls.append(out.count())
        if len(calls) == 1:
            raise Crash("before the work")
        vector = F.array(F.col("payload").cast("float"), F.lit(1.0).cast("float"))
        store.upsert(out.select("key", vector.alias("vector"), F.struct("payload").alias("metadata")))
        if len(calls) == 2:
            raise Crash("after the work, before the acks")
        done = out.select("key", "attempt", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
        return done.where("cast(payload as int) % 2 = 0") if len(calls) == 3 else done  # half of the acks get lost

    for k in range(2):
        q = durable.work(spark, path, check, handler, lease_s=2)
        with pytest.raises(Exception, match="before the"):
            q.awaitTermination(120)
    q = durable.work(spark, path, check, handler, interval="500 milliseconds", lease_s=4)
    try:
        for _ in range(120):
            time.sleep(0.5)
            if len(calls) > 3 and not states_or_none(spark, check):
                break
    finally:
        q.stop()
    assert states(spark, check) == {} and calls[:3] == [20, 20, 20] and 10 in calls[3:]
    stored = store.read().collect()
    assert sorted(r["key"] for r in stored) == sorted(f"k{i}" for i in range(20))


class Calls:
    """A state variable, or the handle, that counts the calls made to it."""

    def __init__(self, log, name="handle"):
        self.log, self.name, self.value = log, name, None

    def getValueState(self, name, *_, **__):
        return Calls(self.log, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.log.append(("handle", "registerTimer", at))

    def deleteTimer(self, at):
        self.log.append(("handle", "deleteTimer", at))

    def exists(self):
        self.log.append((self.name, "exists"))
        return self.value is not None

    def get(self):
        self.log.append((self.name, "get"))
        return self.value if self.name in ("mark", "item", "failed", "attempts") else iter(self.value or [])

    def update(self, value):
        self.log.append((self.name, "update"))
        self.value = value

    put = update

    def appendList(self, value):
        self.log.append((self.name, "appendList"))
        self.value = [*(self.value or []), *value]

    def clear(self):
        self.log.append((self.name, "clear"))
        self.value = None


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getCurrentProcessingTimeInMs


def test_queue_calls(spark):
    """A key's state is read and written once a micro-batch, however many events it has; timers that an event sets and a later one lifts are never made."""
    log: list[tuple] = []
    own = durable.Queue(3, 30, 300, 86_400)
    own.init(Calls(log))
    event = lambda s, kind, attempt=None: {"at": T0 + timedelta(seconds=s), "kind": kind, "attempt": attempt, "payload": f"p{s}", "error": None}
    # Fifty pieces of work: all are handed out and acknowledged but the last, which fails.
    events = [e for n in range(1, 51) for e in (event(2 * n, "enqueue"), event(2 * n + 1, "fail" if n == 50 else "ack", n))]
    out = list(own.handleInputRows(("k",), iter(events), Clock(1000)))
    assert [(r["action"], r["attempt"], r["payload"]) for r in out] == [("hand_out", n, f"p{2 * n}") for n in range(1, 51)]
    assert own.item.value[:3] == ("pending", 1, 50) and own.attempts.value == (50,)
    assert [x for x in log if x[0] == "handle"] == [("handle", "registerTimer", 31_000)] and len(log) <= 8
    del log[:]
    out = list(own.handleInputRows(("k",), iter([event(200, "enqueue")]), Clock(2000)))
    assert len(out) == 1 and [x for x in log if x[0] == "handle"] == [("handle", "deleteTimer", 31_000), ("handle", "registerTimer", 302_000)]


def test_live_batches_calls(spark):
    """Rows before the watermark join those that wait without a reading of them, as few values; then all come out in order."""
    log: list[tuple] = []
    own = batches.Batcher(["_at_us", "id"], ["grp"], ["id"], 30_000_000, 4, False)
    own.init(Calls(log))
    row = lambda i: {"_at_us": i * 1_000_000, "id": i, "grp": "a"}
    for k in range(5):
        assert not list(own.handleInputRows(("a",), iter([row(1000 + 100 * k + i) for i in range(99, -1, -1)]), Clock(900_000)))
    assert not [x for x in log if x[0] in ("waiting", "buffer") and x[1] == "get"]
    assert [x for x in log if x[0] == "handle"] == [("handle", "registerTimer", 1_000_001)] and len(own.waiting.value) == 5
    out = list(own.handleExpiredTimer(("a",), Clock(1_250_000), None))
    assert [r["id"] for r in out] == list(range(1000, 1248)) and {r["reason"] for r in out} == {"count"} and out[-1]["chunk"] == 61
    out = list(own.handleInputRows(("a",), iter([row(5000)]), Clock(4_000_000)))
    assert [r["id"] for r in out] == list(range(1248, 1500)) and out[-1]["session"] == 1
    out = list(own.handleExpiredTimer(("a",), Clock(9_000_000), None))
    assert [(r["id"], r["session"], r["reason"]) for r in out] == [(5000, 2, "idle")] and own.waiting.value is None
