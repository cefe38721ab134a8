"""Exact ranks by brackets, rates over split series, ranks by ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics


def by_hand(rows, points):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {g: tuple(sorted(vs)[max(math.ceil(p * len(vs)), 1) - 1] for p in points) for g, vs in groups.items()}


@pytest.mark.parametrize("bracket", [500_000, 4])
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_nearest_ranks(spark, monkeypatch, bracket, accuracy):
    monkeypatch.setattr(metrics, "BRACKET", bracket)
    monkeypatch.setattr(metrics, "ACCURACY", accuracy)
    monkeypatch.setattr(metrics, "BINS", 7)
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 0.0, r.gauss(0, 1), r.expovariate(1) * 1000, 7.5])) for _ in range(3000)] + [("one", 1.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    points = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: tuple(x[n] for n in points) for x in metrics.nearest_ranks(df, "v", points, ["g"]).collect()}
    assert got == by_hand(rows, points.values())
    whole = metrics.nearest_ranks(df, "v", points).first()
    assert tuple(whole) == by_hand([("x", v) for _, v in rows], points.values())["x"]
    assert metrics.nearest_ranks(df.where("false"), "v", points, ["g"]).count() == 0


def test_rates_of_split_series(spark):
    r = random.Random(1)
    rows = [(g, t, r.choice([0, r.randrange(100), t])) for g in "ab" for t in sorted(r.sample(range(50_000), 300))]
    want, last = {}, {}
    for g, t, v in sorted(rows):
        step = 0 if g not in last else v if v < last[g] else v - last[g]
        last[g] = v
        want[(g, t // 3600 * 3600)] = want.get((g, t // 3600 * 3600), 0) + step
    df = spark.createDataFrame(rows, "g string, t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(x["g"], int(x["window_start"].timestamp())): x["increase"] for x in metrics.increase_rate(df, "v", "ts", "1 hour", ["g"]).collect()}
    assert got == want


def test_ranks_by_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0.9, 0.901, 0.95, 0.5]), r.randrange(5)) for i in range(300)]
    got = metrics.ranked_by_recall(spark.createDataFrame(rows, "c long, r double, l long").repartition(5), "r", "l", "c").collect()
    want = sorted(rows, key=lambda x: (-round(x[1], 2), x[2], x[0]))
    assert [x["c"] for x in sorted(got, key=lambda x: x["rank"])] == [x[0] for x in want] and {x["rank"] for x in got} == set(range(1, 301))
