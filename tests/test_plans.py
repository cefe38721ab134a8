import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.functions.embed import HashingEmbedder, generate, validated_items
from tessera.operators import etl, knn, metrics, queue, store, threads
from tessera.plans.search import SearchQuery, search
from tessera.plans.search import knn as knn_one
from tessera.sources import readers, sinks
from tessera.streaming import ingest

POINTS = [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.9, 0.1, 0.0]), ("zero", [0.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "key string, vector array<float>").withColumn("metadata", F.struct(F.length("key").alias("n")))


def test_search(points):
    assert [(r.key, round(r.distance, 6)) for r in knn_one(points.where("key <> 'zero'"), SearchQuery([1.0, 0, 0], 2)).collect()] == [("a", 1.0), ("c", round(0.9 / math.hypot(0.9, 0.1), 6))]
    assert [r.key for r in search(points, [1.0, 0, 0]).collect()] == ["a", "c"]
    assert {r.key for r in search(points, [1.0, 0, 0], threshold=0).collect()} == {"a", "b", "c"}
    for bad in (dict(vector=[1.0], k=0), dict(vector=[1.0], k=1001), dict(vector=[float("nan")]), dict(), dict(vector=[1.0], term="x"), dict(term="x")):
        with pytest.raises(ValueError):
            search(points, **bad)


def test_plans_agree(points, spark):
    asked = spark.createDataFrame([(1, [1.0, 0.2, 0.0]), (2, [0.0, 1.0, 1.0])], "query_id long, query array<float>")
    a = {(r.query_id, r.key, r.rank) for r in knn.knn_sql(points, asked, 2).collect()}
    assert a == {(r.query_id, r.key, r.rank) for r in knn.knn_batched(points, asked, 2).collect()} and len(a) == 4


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -1.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([0.0, 0.0],)], "v array<float>")
    assert [r.x for r in df.select(vectors.is_valid(F.col("v"), 2).alias("x")).collect()] == [True, False, False, False, True]
    assert df.select(vectors.normalized(F.col("v")).alias("x")).collect()[4].x is None
    named = spark.sql("select map('other', array(1), '', array(2)) as v").select(vectors.named_vector(F.col("v")).alias("x")).first().x
    assert named == [2]


def test_store(points, spark, tmp_path):
    t = store.VectorTable(spark, str(tmp_path / "t"), 3)
    t.write(points)
    new = spark.createDataFrame([("a", [0.0, 0.0, 1.0], 1), ("a", [0.0, 1.0, 1.0], 2), ("d", [1.0, 1.0, 1.0], 1)], "key string, vector array<float>, seq int").withColumn("metadata", F.struct(F.lit(7).alias("n")))
    for _ in range(2):
        t.upsert(new, ["seq"])
        assert {r.key: r.vector for r in t.read().collect()}["a"] == [0.0, 1.0, 1.0] and t.read().count() == 5
    t.delete(spark.createDataFrame([("d",), ("nowhere",)], "key string"))
    t.replace_metadata(spark.createDataFrame([("b", 70)], "key string, n int").select("key", F.struct("n").alias("metadata")))
    assert {r.key: r.metadata.n for r in t.read().collect()} == {"a": 7, "b": 70, "c": 1, "zero": 4}
    assert t.stats().first().n_points == 4
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([("x", [1.0])], "key string, vector array<float>"))


def test_queue(spark):
    rows = [("k0", "pending", 0, 1, None), ("k1", "pending", 0, 2, None), ("k2", "pending", 2, 3, None), ("k3", "pending", 3, 4, "e"), ("k4", "processing", 1, 5, None)]
    q = spark.createDataFrame(rows, "key string, status string, retry_count int, created_at int, error_message string")
    done = spark.createDataFrame([("k0", True, None), ("k1", False, "x"), ("k2", False, "x"), ("k3", False, "x")], "key string, ok boolean, error string")
    after = {r.key: (r.status, r.retry_count) for r in queue.transition(q, done).collect()}
    assert after == {"k1": ("pending", 1), "k2": ("pending", 3), "k3": ("failed", 3), "k4": ("processing", 1)}
    assert queue.health(queue.status_counts(q), {"pending": 3}).first().issues == "pending: 4"
    again = queue.enqueue(q, spark.createDataFrame([("k3", "pending", 9, 10, "old", 1)], "key string, status string, retry_count int, created_at int, error_message string, seq int"), ["seq"])
    assert again.where("key = 'k3'").first().retry_count == 0 and again.count() == 5


def test_metrics(spark):
    v = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    s = metrics.response_stats(v, "v").first()
    assert (s.p50, s.p95, s.p99) == (2, 4, 4)
    assert metrics.response_stats(v.where("v > 9"), "v").first().p50 == 0
    p = spark.createDataFrame([(5.0, 0.99, "a"), (3.0, 0.97, "b"), (4.0, 0.96, "c"), (1.0, 0.90, "d")], "cost double, gain double, k string")
    assert {r.k for r in metrics.pareto_front(p, "cost", "gain", "k").collect()} == {"a", "b", "d"}
    res = spark.createDataFrame([(1, "a"), (1, "x"), (1, "c")], "query_id int, key string")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "query_id int, key string")
    assert round(knn.recall_at_k(res, truth, 10).first().recall, 4) == 0.6667


def test_threads(spark):
    rows = [(1, 10, None, "root"), (1, 11, 10, "two"), (1, 12, 11, "three"), (1, 13, 99, "orphan"), (2, 20, 10, "elsewhere"), (3, 30, 31, "loop"), (3, 31, 30, "loop")]
    posts = spark.createDataFrame(rows, "conv int, id int, parent int, body string")
    got = {r.key: (r.root, r.depth) for r in threads.paths(posts, "conv", "id", "parent", 8).where("conversation < 3").collect()}
    assert got == {10: (10, 0), 11: (10, 1), 12: (10, 2), 13: (13, 0), 20: (20, 0)}
    texts = {r.key: r.content for r in threads.thread_texts(posts.where("conv = 1"), "conv", "id", "parent", "body", 200).collect()}
    assert texts[12] == "[root] root\n[context] two\n[current] three"


def test_etl(spark):
    posts = spark.createDataFrame([("1", "hello", None, 0), ("0", "x", None, 1), ("2", "  ", None, 2), ("3", "three", "1", 3), ("1", "again", None, 4), ("4", "four", "77", 5)], "id string, body string, q string, row int")
    ok = etl.first_of_key(etl.valid(posts, "id", "body"), "id", ["row"])
    assert sorted(r.id for r in ok.collect()) == ["1", "3", "4"]
    quoted = {r.id: r.quoted_text for r in etl.with_quoted(ok, "id", "q", "body", "row").collect()}
    assert quoted == {"1": None, "3": "hello", "4": None}
    assert [tuple(r) for r in etl.missing_quotes(posts, "id", "q").collect()] == [("4", "77")]
    numbered = etl.batched(posts, ["row"], 4).orderBy("row").collect()
    assert [r.row_index for r in numbered] == list(range(6)) and numbered[4].batch_file == "batch_0001"
    assert etl.describe(posts).where("text_hint").collect()[0].column == "body"
    with pytest.raises(ValueError):
        etl.require(posts, "nowhere")


def test_batches_over_many_partitions(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.repeat(F.col("id").cast("string"), 30).alias("wide"))
    changed = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "31"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = etl.batched(rows, ["k"], 100).orderBy("k").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.row_index for r in got] == list(range(20_000)) and all(r.batch_file == f"batch_{i // 100:04d}" for i, r in enumerate(got))


def test_round_trips(points, spark, tmp_path):
    expected = {k: v for k, v in POINTS}
    sinks.export_parquet(points, str(tmp_path / "p"), "small", "zstd")
    sinks.export_jsonl(points, str(tmp_path / "j"), "gzip")
    sinks.export_csv(points, str(tmp_path / "c"), 3)
    assert {r.key: [round(x, 6) for x in r.vector] for r in spark.read.parquet(str(tmp_path / "p")).collect()} == expected
    assert {r.key: r.metadata for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {k: f'{{"n":{len(k)}}}' for k in expected}
    j = readers.jsonl(spark, str(tmp_path / "j"), "key string, vector array<float>, metadata struct<n:int>")
    assert {r.key: r.metadata.n for r in j.collect()} == {k: len(k) for k in expected}
    c = spark.read.options(header=True, escape='"').csv(str(tmp_path / "c"))
    assert c.columns == ["key", "dim_0", "dim_1", "dim_2", "metadata"] and c.count() == 4
    back = readers.wide_vectors(sinks.wide(points, 3))
    assert {r.key: [round(x, 6) for x in r.vector] for r in back.collect()} == expected
    index = sinks.npy(points, str(tmp_path / "n"), 2)
    keys = {(r.part.rsplit("/", 1)[1], r.pos): r.key for r in index.collect()}
    rows = readers.npy(spark, str(tmp_path / "n")).collect()
    assert {keys[(r.part.rsplit("/", 1)[1], r.pos)]: [round(x, 6) for x in r.vector] for r in rows} == expected


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text('media_id,tweet_id,media_url,media_type,width,height,archive_upload_id,updated_at\n1, 2 ,"http://x/""q""",photo,1,1,1,\n,3,u,,,,,\n4,5,"two\nlines",,,,,\n')
    assert sorted(r.key for r in readers.media_rows(spark, str(tmp_path / "m")).collect()) == ["2_1", "5_4"]
    (tmp_path / "t.jsonl").write_text('{"key":"a","text":"xy","created_at":"2024-01-01T00:00:00Z"}\nbroken\n{"key":"b","text":"é","created_at":"2024-01-02T00:00:00Z"}\n')
    s = readers.text_stats(readers.jsonl(spark, str(tmp_path / "t.jsonl"), readers.TEXTS)).first()
    assert (s.n, s.bytes) == (2, 4)
    for n in ("x.pending.q", "y.failed.q", "z.q"):
        (tmp_path / "m" / n).write_text("12")
    assert {r.state: r.n for r in readers.queue_files(readers.file_ids(spark, str(tmp_path / "m"))).collect()} == {"pending": 1, "failed": 1, "other": 2}


def test_embedding(spark):
    df = spark.createDataFrame([("a", "Hello world"), ("b", "hello WORLD"), ("c", " "), (None, "x")], "key string, body string")
    got = {r.key: r.vector for r in generate(df, "key", "body", HashingEmbedder(16)).collect()}
    assert set(got) == {"a", "b"} and got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-6
    with pytest.raises(ValueError):
        validated_items(df.select("key", F.col("body").alias("content")))


def test_stream_equals_batch(spark, tmp_path):
    schema = "id string, text string, ts timestamp"
    src = str(tmp_path / "in")
    rows = [("1", "one @x"), ("2", "https://t.co/a"), ("3", "three"), ("1", "one @x"), (None, "x"), ("4", None)]
    spark.createDataFrame(rows, "id string, text string").withColumn("ts", F.current_timestamp()).coalesce(1).write.parquet(src)
    t = store.VectorTable(spark, str(tmp_path / "t"), 64)
    for _ in range(2):
        q = ingest.start(ingest.source(spark, src, schema), t, str(tmp_path / "cp"))
        q.awaitTermination()
        assert {r.key: r.metadata.text for r in t.read().collect()} == {"1": "one @x", "3": "three"}
    spark.createDataFrame([("5", "five"), ("3", "other")], "id string, text string").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(src)
    q = ingest.start(ingest.source(spark, src, schema), t, str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.key: r.metadata.text for r in t.read().collect()} == {"1": "one @x", "3": "three", "5": "five"}
    assert ingest.stats(q)["batches"] >= 1


def test_queries_beyond_one_block_are_answered(spark, monkeypatch):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0, float(i % 3)]) for i in range(30)]
    points = spark.createDataFrame(rows, "key long, vector array<float>")
    queries = points.selectExpr("key as query_id", "vector as query")
    plans = lambda: [knn.knn_sql(points, queries, 2), knn.knn_two_phase(points, queries, 4, 2, 3)]
    whole = [sorted((r.query_id, r["rank"], r.key) for r in p.collect()) for p in plans()]
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    assert [sorted((r.query_id, r["rank"], r.key) for r in p.collect()) for p in plans()] == whole
    assert {q for q, _, _ in whole[0]} == set(range(30))


def test_threads_deeper_than_64_and_cycles(spark):
    chain = [("c", i, i - 1 if i else None) for i in range(150)]
    ring = [("r", 0, 2), ("r", 1, 0), ("r", 2, 1), ("r", 3, 2)]
    posts = spark.createDataFrame(chain + ring, "conversation string, key long, parent long")
    got = {(r.conversation, r.key): (r.root, r.depth, list(r.path)) for r in threads.paths(posts, "conversation", "key", "parent").collect()}
    assert len(got) == 154 and all(got["c", i] == (0, i, list(range(i + 1))) for i in range(150))
    assert got["r", 0] == (1, 2, [1, 2, 0]) and got["r", 3] == (0, 3, [0, 1, 2, 3])
    posts.where("conversation = 'c'").createOrReplaceTempView("deep_posts")
    walked = spark.sql(threads.paths_sql("deep_posts", "conversation", "key", "parent")).collect()
    assert {(r.key, r.root, r.depth) for r in walked} == {(i, 0, i) for i in range(150)}


def test_depths_without_paths(spark):
    """Chains, trees, replies to absent posts, cycles and what hangs below them."""
    import random

    from tessera.operators import threads

    r = random.Random(6)
    rows = [(1, i, i - 1 if i else None) for i in range(300)]
    rows += [(2, i, r.randrange(i) if i else None) for i in range(200)] + [(2, 900, 12345)]
    rows += [(3, 1, 2), (3, 2, 3), (3, 3, 1), (3, 4, 3), (3, 5, 4), (3, 6, None), (3, 7, 6), (4, 1, 1), (4, 2, 1), (None, 1, None)]
    posts = spark.createDataFrame(rows, "c long, k long, p long")
    one = lambda df: sorted(map(str, ((x["conversation"], x["key"], x["root"], int(x["depth"])) for x in df.collect())))
    assert one(threads.depths(posts.where("c is not null"), "c", "k", "p")) == one(threads.paths(posts.where("c is not null"), "c", "k", "p"))
