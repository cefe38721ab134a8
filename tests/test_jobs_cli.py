import json
import time

import pytest

from tessera import cli
from tessera.operators import ann, knn
from tessera.sources.jobs import Busy, ExportJobs


def test_export_jobs(spark):
    jobs = ExportJobs(spark)
    slow = jobs.start(lambda: spark.range(10**12).selectExpr("sum(id % 7)").collect())
    with pytest.raises(Busy):
        jobs.start(lambda: None)
    time.sleep(1)
    jobs.cancel(slow)
    assert jobs.wait(slow)["status"] == "cancelled"
    assert jobs.wait(jobs.start(lambda: spark.range(3).count()))["status"] == "completed"
    assert jobs.wait(jobs.start(lambda: 1 / 0))["status"] == "failed"


def test_cli(spark, tmp_path, capsys):
    rows = [(1, "deep neural networks https://t.co/x", None), (2, "@a cooking pasta tonight", 1), (3, " ", None), (0, "zero", None)]
    spark.createDataFrame(rows, "tweet_id long, full_text string, quoted_tweet_id long").write.parquet(str(tmp_path / "in"))
    o = cli.parser().parse_args(["process-parquet", str(tmp_path / "in"), "--store", str(tmp_path / "s"), "--quoted-column", "quoted_tweet_id", "--output", str(tmp_path / "out")])
    stats = cli.process(spark, o)
    assert stats["n"] == 2 and stats["with_quotes"] == 1
    o.output = None
    assert cli.process(spark, o)["n"] == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    from tessera.functions.embed import HashingEmbedder
    from tessera.operators.store import VectorTable
    from tessera.plans.search import search

    found = search(VectorTable(spark, str(tmp_path / "s"), 64).read(), term="neural networks deep", embedder=HashingEmbedder(64), filter={"text": "NEURAL"}, prefix="metadata").collect()
    assert [r.key for r in found] == ["1", "2"]  # the second quotes the first
    assert json.dumps(stats)


def test_approximate_search_recalls(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((400, 16)) + np.repeat(np.eye(4, 16) * 6, 100, 0)
    points = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)], "key string, vector array<float>")
    asked = spark.createDataFrame([(i, x[i * 40].tolist()) for i in range(8)], "query_id long, query array<float>")
    truth = knn.knn_batched(points, asked, 5)
    celled, centres = ann.with_cells(points, 4)
    assert knn.recall_at_k(ann.cell_search(celled, centres, asked, 5, 2), truth, 5).first().recall > 0.9
    coded, books = ann.product_codes(points, 16, 4)
    assert knn.recall_at_k(ann.product_search(coded, books, asked, 5, 20), truth, 5).first().recall >= 0.9
