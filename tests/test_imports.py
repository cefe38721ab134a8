import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import etl, imports, metrics, queue
from tessera.operators.store import Conflict, VectorTable, point_ref
from tessera.plans import filters
from tessera.sources import readers, sinks
from tessera.streaming.guard import CLOSED, HALF_OPEN, OPEN, Breaker, Refused, with_retries


def rows(spark, *items):
    return spark.createDataFrame(items, "key string, vector array<float>, n int").select("key", "vector", F.struct("n").alias("metadata"))


def test_versions(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "t"), 2)
    t.upsert(rows(spark, ("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2)))
    before = t.read()
    t.upsert(rows(spark, ("a", [0.5, 0.5], 3), ("c", [1.0, 1.0], 4)))
    t.delete(spark.createDataFrame([("b",), ("nowhere",)], "key string"))
    assert {r.key: r.metadata.n for r in before.collect()} == {"a": 1, "b": 2}  # an open reader keeps its version
    assert {r.key: r.metadata.n for r in t.read().collect()} == {"a": 3, "c": 4} and {r.key for r in t.read(1).collect()} == {"a", "b"}
    t.upsert(rows(spark, ("b", [1.0, 0.0], 5)))
    t.replace_metadata(spark.createDataFrame([("c", 9)], "key string, n int").select("key", F.struct("n").alias("metadata")))
    want = {"a": 3, "b": 5, "c": 9}
    assert {r.key: r.metadata.n for r in t.read().collect()} == want
    t.compact()
    assert t._current()["deltas"] == [] and {r.key: r.metadata.n for r in t.read().collect()} == want
    assert t.vacuum(1) == 5 and {r.key: r.metadata.n for r in t.read().collect()} == want
    # A version file that was cut off isn't a version; two writers can't publish the same one.
    (tmp_path / "t" / "_versions" / f"{99:012d}").write_text('{"base": "ba')
    assert {r.key: r.metadata.n for r in t.read().collect()} == want
    seen = [v for v in t.versions() if v != 99]
    (tmp_path / "t" / "_versions" / f"{seen[-1] + 1:012d}").write_text("{}")
    t.versions = lambda: seen
    with pytest.raises(Conflict):
        t.upsert(rows(spark, ("z", [1.0, 0.0], 5)))


def test_delete_first_and_last(spark, tmp_path):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    t = VectorTable(spark, str(tmp_path / "t"), 2)
    assert t.delete(keys("a", "b")) == {"requested": 2, "deleted": 0} and t.versions() == []
    t.write(rows(spark, ("a", [1.0, 0.0], 1), ("b", [0.0, 1.0], 2), ("c", [0.0, 1.0], 3)))
    assert t.delete(keys("b", "b", "zz", None)) == {"requested": 2, "deleted": 1}
    assert {r.key: r.metadata.n for r in t.read().collect()} == {"a": 1, "c": 3} and t.read().columns == ["key", "vector", "metadata"]
    assert t.replace_metadata(spark.createDataFrame([("c", 9), ("b", 9), ("q", 9)], "key string, n int").select("key", F.struct("n").alias("metadata"))) == {"updated": 1, "failed": 2}
    assert t.delete(keys("a", "c")) == {"requested": 2, "deleted": 2} and t.read().count() == 0
    t.compact()
    assert t.read().count() == 0 and t.delete(keys("a")) == {"requested": 1, "deleted": 0}
    t.upsert(rows(spark, ("a", [1.0, 0.0], 7)))
    assert [r.metadata.n for r in t.read().collect()] == [7]


def test_writers_at_once(spark, tmp_path, monkeypatch):
    """Another writer publishes between a writer's look and its publication."""
    path = str(tmp_path / "t")
    t, other = VectorTable(spark, path, 1), VectorTable(spark, path, 1)
    t.write(rows(spark, ("a", [1.0], 1), ("b", [2.0], 2), ("c", [3.0], 3)))
    made, add = [], VectorTable._add

    def between(action):
        def run(self, df, kind):
            folder = add(self, df, kind)
            if self is t:
                made.append(folder)
                if len(made) == 1:
                    action()
            return folder

        made.clear()
        monkeypatch.setattr(VectorTable, "_add", run)

    meta = lambda k, n: spark.createDataFrame([(k, n)], "key string, n int").select("key", F.struct("n").alias("metadata"))
    state = lambda: {r.key: (r.vector[0], r.metadata.n) for r in t.read().collect()}
    # Disjoint keys: the delta goes on top as it is.
    between(lambda: other.upsert(rows(spark, ("b", [5.0], 5))))
    assert t.replace_metadata(meta("a", 8)) == {"updated": 1, "failed": 0}
    assert len(made) == 1 and state() == {"a": (1.0, 8), "b": (5.0, 5), "c": (3.0, 3)}
    # A shared key: it is made anew, with the other's vector.
    between(lambda: other.upsert(rows(spark, ("c", [6.0], 6))))
    assert t.replace_metadata(meta("c", 9)) == {"updated": 1, "failed": 0}
    assert len(made) == 2 and state()["c"] == (6.0, 9)
    # A compaction in between, and one by itself.
    between(other.compact)
    t.upsert(rows(spark, ("d", [7.0], 7)))
    assert state() == {"a": (1.0, 8), "b": (5.0, 5), "c": (6.0, 9), "d": (7.0, 7)}
    between(lambda: other.delete(spark.createDataFrame([("d",)], "key string")))
    assert not t.compact() and set(state()) == {"a", "b", "c"}
    monkeypatch.setattr(VectorTable, "_add", add)
    assert t.compact() and t._current()["deltas"] == []
    # A version file that another is just writing is waited for; one that stays broken isn't.
    assert VectorTable.GRACE > 0


def test_many_small_upserts_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VectorTable, "COMPACT", 3)
    t = VectorTable(spark, str(tmp_path / "t"), 1)
    for i in range(5):
        t.upsert(rows(spark, (f"k{i % 2}", [float(i)], i)))
    assert len(t._current()["deltas"]) < 3 and {r.key: r.metadata.n for r in t.read().collect()} == {"k0": 4, "k1": 3}


def test_bulk_import_and_generate(spark, tmp_path):
    good = rows(spark, ("a", [1.0, 0.0], 1), ("", [1.0, 0.0], 2), (None, [1.0, 0.0], 3), ("b", [1.0], 4), ("c", [float("nan"), 0.0], 5))
    good.write.parquet(str(tmp_path / "x"))
    t = VectorTable(spark, str(tmp_path / "t"), 2)
    found = imports.profile_summary(imports.bulk_import(spark, [str(tmp_path / "x")], t)).first()
    assert (found.n, round(found.share, 2)) == (5, 0.2) and [r.key for r in t.read().collect()] == ["a"]
    assert t.keys("key", 5).columns == ["key"]
    from tessera.functions.embed import HashingEmbedder

    n = imports.generate_and_store(spark.createDataFrame([("x", "some words"), ("y", " "), (None, "z"), ("x", "some words")], "id string, body string"), "id", "body", VectorTable(spark, str(tmp_path / "g"), 8), HashingEmbedder(8))
    assert n == 1 and imports.eta(50, 200, 10)["eta_seconds"] == 30 and imports.eta(0, 5, 0)["eta_seconds"] is None


def test_point_refs_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([("12",), ("9223372036854775808",), ("ABCDEF00-0000-0000-0000-000000000001",), ("x",), (None,)], "key string")
    assert [tuple(r.r) for r in df.select(point_ref(F.col("key")).alias("r")).collect()] == [(12, None, "12"), (None, None, "9223372036854775808"), (None, "abcdef00-0000-0000-0000-000000000001", "ABCDEF00-0000-0000-0000-000000000001"), (None, None, "x"), (None, None, None)]
    (tmp_path / "f").write_bytes(b"abc")
    assert readers.file_hashes(spark, str(tmp_path)).first().sha256.startswith("ba7816bf")


def test_breaker_and_retries():
    now = [0.0]
    b = Breaker(failures=2, rest=10, probes=2, clock=lambda: now[0])

    def bad():
        raise OSError("down")

    for _ in range(2):
        with pytest.raises(OSError):
            b.call(bad)
    assert b.state == OPEN
    with pytest.raises(Refused):
        b.call(lambda: 1)
    now[0] = 10
    assert b.state == HALF_OPEN and b.call(lambda: 1) == 1 and b.state == HALF_OPEN
    with pytest.raises(OSError):
        b.call(bad)
    assert b.state == OPEN
    now[0] = 20
    assert [b.call(lambda: 1) for _ in range(2)] == [1, 1] and b.state == CLOSED
    r = Breaker(failures=99, rate=0.5, calls=4, clock=lambda: now[0])
    for ok in (True, True, False, False):
        r.record(ok)
    assert r.state == OPEN
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")
        return "up"

    assert with_retries(flaky, sleep=waits.append) == "up" and waits == [1.0, 2.0]
    with pytest.raises(OSError):
        with_retries(bad, retries=1, sleep=waits.append)


def test_small_additions(spark, tmp_path):
    v = spark.createDataFrame([([0.5, -0.5, 0.01],)], "v array<float>")
    assert v.select(vectors.pair_bits(F.col("v"), F.lit(0.1)).alias("c")).first().c == [6, 2]
    posts = spark.createDataFrame([(1, 10, None, "a"), (1, 11, 10, "b"), (2, 12, 10, "c")], "conv int, id int, q int, body string")
    got = {r.id: r.quoted_text for r in etl.quoted_in_conversation(posts, "conv", "id", "q", "body", "body").collect()}
    assert got == {10: None, 11: "a", 12: None}
    deep = spark.sql("select named_struct('id', 1L, 'm', map('k', 2L), 'l', array(3L), 's', cast(null as struct<x:bigint>), 'i', 4) as m")
    assert deep.select(etl.sanitized(F.col("m"), deep.schema["m"].dataType).alias("m")).first().m.asDict(True) == {"id": "1", "m": {"k": "2"}, "l": ["3"], "s": None, "i": 4}
    texts = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], "key string, text string, created_at int")
    asked = spark.createDataFrame([("a",), ("q",)], "key string")
    assert [tuple(r) for r in readers.text_lookup(texts, asked).select("key", "text").collect()] == [("a", "new")]
    assert {r.key: r.found for r in readers.text_exists(texts, asked).collect()} == {"a": True, "q": False}
    q = spark.sql("select * from values ('a', 'pending', 0, timestamp_seconds(0)), ('b', 'pending', 2, timestamp_seconds(0)), ('c', 'failed', 0, timestamp_seconds(0)), ('d', 'pending', 1, timestamp_seconds(0)) as t(key, status, retry_count, created_at)")
    assert [r.key for r in queue.due(q, F.timestamp_seconds(F.lit(40)), 9).collect()] == ["a", "d"]
    assert filters.moment("2024-01-01") == filters.moment(1704067200000) == filters.moment(1704067200) == 1704067200 and filters.moment("nothing") is None
    for _ in range(2):
        sinks.failed_items(asked, str(tmp_path / "bad"))
    assert spark.read.option("header", True).csv(str(tmp_path / "bad")).count() == 4
    assert sinks.report(spark.sql("select 1 as n, '<' as x"), "t").count("&lt;") == 1
    lines = spark.createDataFrame([(1.0, 0.951, "b"), (1.0, 0.949, "a"), (0.5, 0.95, "c")], "l double, r double, c string")
    assert [r.c for r in metrics.ranked_by_recall(lines, "r", "l", "c").orderBy("rank").collect()] == ["c", "a", "b"]
    assert readers.first_rows(lines, ["l", "c"], 1).first().c == "c"
