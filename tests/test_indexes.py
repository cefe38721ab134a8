"""Indexes on disk: cells, graph and postings against scans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, knn
from tessera.operators.cells import CellIndex
from tessera.operators.postings import TextIndex, has_text, has_words


def mixture(spark, n, dim, groups, seed=0):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, dim))
    x = centres[r.integers(0, groups, n)] + 0.35 * r.standard_normal((n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vector array<float>")


def asked(points, every):
    return points.where(F.col("key") % every == 0).select(F.col("key").alias("query_id"), F.col("vector").alias("query"))


def rows(df):
    return sorted((r.query_id, r.rank, r.key, round(r.distance, 6)) for r in df.collect())


def test_cells(spark, tmp_path):
    points = mixture(spark, 3000, 16, 40).unionByName(spark.createDataFrame([(9001, None), (9002, [0.0] * 16), (9003, [1.0] * 3), (9004, [float("nan")] * 16)], "key long, vector array<float>"))
    queries = asked(points, 20)
    truth = knn.knn_batched(points, queries, 10)
    index = CellIndex(spark, str(tmp_path / "i"))
    index.build(points.where("key % 3 <> 0"), 36)
    index.add(points.where("key % 3 = 0"))  # nothing is fitted again
    leaves = len(index._tree()[0])
    assert rows(index.search(queries, 10, leaves)) == rows(truth)
    found = index.report(queries, truth, 10, 4).first()
    assert found.recall >= 0.9 and found.share_scored < 0.2 and found.n_queries == 150
    one = index.report(queries.where("query_id = 0"), truth.where("query_id = 0"), 10, 2).first()
    assert one.files_read < found.files / 6 and found.files >= 36
    plan = index.search(queries.where("query_id = 0"), 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_graph(spark, tmp_path):
    points = mixture(spark, 3000, 16, 40).unionByName(spark.createDataFrame([(9001, None), (9002, [0.0] * 16)], "key long, vector array<float>"))
    queries = asked(points, 20)
    truth = knn.knn_batched(points, queries, 10)
    index = graph.GraphIndex(spark, str(tmp_path / "g"))
    index.build(points, degree=12, rounds=3)
    found = index.report(queries, truth, 10, beam=32).first()
    assert found.recall >= 0.9 and found.share_scored < 0.2 and found.n_queries == 150
    degree = index._read("links").agg(F.max(F.size("others"))).first()[0]
    assert degree <= 24 and graph.build(points.where("key < 0")).count() == 0


def test_graph_shuffles(spark, tmp_path):
    """Meetings send codes and what may enter a list; a search sends ids and scores."""
    points = mixture(spark, 1500, 64, 1)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    index = graph.GraphIndex(spark, str(tmp_path / "g"))
    a = sent()
    index.build(points, degree=12, rounds=2)
    b = sent()
    beams = index.beams(asked(points, 5), beam=24).select("query_id", F.size("seen").alias("n"), F.size(F.array_distinct("seen")).alias("once"), F.col("beam.key").alias("beam")).collect()
    c = sent()
    assert len(beams) == 300 and all(r.n == r.once for r in beams)
    assert (b - a) / 1500 < 10_000 and (c - b) / sum(r.n for r in beams) < 25


TEXTS = [(1, "The quick brown fox"), (2, "quick, THE Fox_y fox"), (3, None), (4, ""), (5, "ÄÖ über ñandú"), (6, "a b"), (7, "xx the the"), (8, "brownish quickly"), (9, "50% off! the fox"), (None, "the fox")]


@pytest.mark.parametrize("needle", ["the", "the fox", "FOX the", "quick", "own f", "ÜBER", "b", "", "!", "50%", "zz", "quick brown fox jumps", "über ñandú"])
def test_postings(spark, tmp_path_factory, needle):
    index = TextIndex(spark, str(spark_index(spark, tmp_path_factory)))
    df = spark.createDataFrame(TEXTS, "id long, body string").where("id is not null")
    want = lambda test: sorted(r.id for r in df.where(test).collect())
    got = lambda found: sorted(r.id for r in found.collect())
    assert got(index.tokens(needle)) == want(has_words(F.col("body"), needle))
    assert got(index.contains(needle)) == want(has_text(F.col("body"), needle))
    if needle == "the":
        assert got(index.tokens(needle)) == [1, 2, 7, 9] and got(index.contains("OWN F")) == [1]


_made = {}


def spark_index(spark, factory):
    if "path" not in _made:
        _made["path"] = factory.mktemp("postings")
        TextIndex(spark, str(_made["path"])).build(spark.createDataFrame(TEXTS, "id long, body string"), "id", "body")
    return _made["path"]


def test_postings_skip_files(spark, tmp_path, monkeypatch):
    from tessera.operators import postings

    monkeypatch.setattr(postings, "BLOCK_KEYS", 100)
    r = np.random.default_rng(0)
    texts = [(i, " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(6)) + (" needle" if i % 400 == 7 else "")) for i in range(2000)]
    df = spark.createDataFrame(texts, "id long, body string")
    index = TextIndex(spark, str(tmp_path / "p"))
    index.build(df, "id", "body", files=16)
    assert sorted(x.id for x in index.tokens("needle").collect()) == [7, 407, 807, 1207, 1607] == sorted(x.id for x in index.contains("EEDL").collect())
    lists = index.postings(["wneedle"])
    assert lists.select("_metadata.file_path").distinct().count() <= 2 and lists.agg(F.max(F.size("keys"))).first()[0] <= 5
    assert "PushedFilters: [In(token" in lists._jdf.queryExecution().executedPlan().toString() or "EqualTo(token" in lists._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in index.rare(["wneedle", "tnee"]).collect()][0][1] == 5


@pytest.mark.parametrize("held", [1, 3, 1000])
def test_partial_lists(monkeypatch, held):
    from collections import defaultdict

    import pyarrow as pa

    from tessera.operators import postings

    monkeypatch.setattr(postings, "HELD_PAIRS", held)
    rows_ = [("a", 0, ["x", "y"]), ("b", 1, ["x"]), ("c", 0, []), ("a", 0, ["x", "y"]), ("d", 0, ["ü", "x", "z"])]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.list_(pa.string()))], ["key", "_block", "tokens"])
    got, want = defaultdict(list), defaultdict(list)
    for out in postings._partial_lists(iter([batch(rows_[:2]), batch(rows_[2:3]), batch(rows_[3:])])):
        for r in out.to_pylist():
            got[r["token"], r["_block"]] += r["keys"]
    for key, block, tokens in rows_:
        for t in tokens:
            want[t, block].append(key)
    assert got == want
    assert not list(postings._partial_lists(iter([]))) and not list(postings._partial_lists(iter([batch(rows_[2:3])])))


@pytest.mark.parametrize("held", [1, 40, 100_000])
def test_trigram_lists(monkeypatch, held):
    """The lists of a plain count, characters beyond 16 bits included, and little memory for each pair of trigram and text."""
    import tracemalloc
    from collections import defaultdict

    import pyarrow as pa

    from tessera.operators import postings

    monkeypatch.setattr(postings, "HELD_PAIRS", held)
    texts = [("a", 0, "abcabc"), ("b", 1, "abcd"), ("c", 0, "ab"), ("d", 0, "\U0001f600\U0001f601\U0010ffff bc"), ("e", 0, ""), ("a", 0, "abc"), *((f"k{i}", i % 2, f"über {i} ñandú\x00") for i in range(70))]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part])], ["key", "_block", "low"])
    got, want = defaultdict(list), defaultdict(list)
    for out in postings._trigram_lists(iter([batch(texts[:3]), batch(texts[3:])])):
        for r in out.to_pylist():
            got[r["token"], r["_block"]] += r["keys"]
    for key, block, text in texts:
        for g in {text[i : i + 3] for i in range(len(text) - 2)}:
            want[f"t{g}", block].append(key)
    assert got == want
    assert not list(postings._trigram_lists(iter([]))) and not list(postings._trigram_lists(iter([batch(texts[2:3])])))
    r = np.random.default_rng(0)
    long = [(f"{i}", 0, "".join(map(chr, r.integers(97, 123, 3000)))) for i in range(64)]
    tracemalloc.start()
    n = sum(len(x) for out in postings._trigram_lists(iter([batch(long)])) for x in out.column("keys"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak / n < 150
