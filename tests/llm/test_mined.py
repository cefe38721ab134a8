"""Hard negatives, language identification and golden records against brute force."""

import math
import os
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import golden, hard_negatives, language

SF = "/root/testdata/sf0.001"

# ---- golden records ----

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, part int, kind string, cluster string, deal int"
TRUST = ["crm", "web", "store", "partner"]


def filled(s):
    return s if s is not None and s.strip(" \t\n\v\f\r") else None


def best(rows, value, order):
    rows = [r for r in rows if value(r) is not None]
    return min(rows, key=order) if rows else None


def survivors(rows):
    groups = defaultdict(list)
    for r in rows:
        r = dict(r, source=filled(r["source"]), name=filled(r["name"]), email=filled(r["email"]), city=filled(r["city"]), segment=filled(r["segment"]))
        groups[r["client_id"] if r["master_id"] is None else r["master_id"]].append(r)
    out = []
    for cluster, own in groups.items():
        dated = [r["updated_at"] for r in own if r["updated_at"]]
        latest = max(dated) if dated else None
        cents = lambda r: None if r["balance"] is None or not math.isfinite(r["balance"]) or abs(r["balance"]) >= 9e16 else math.floor(r["balance"] * 100 + 0.5)
        trust = lambda r: TRUST.index(r["source"]) if r["source"] in TRUST else 4
        recent = lambda r: (r["updated_at"] is None, -(r["updated_at"] - datetime(2000, 1, 1)).total_seconds() if r["updated_at"] else 0, trust(r), r["client_id"] is None, r["client_id"] or 0)
        stale = lambda r: r["updated_at"] is None or latest - r["updated_at"] > timedelta(hours=1440)  # noqa: B023, E731
        trusted = lambda r: (stale(r), trust(r), recent(r))  # noqa: B023, E731
        seg = best(own, lambda r: r["segment"], recent)
        email = best(own, lambda r: r["email"], trusted)
        name = best(own, lambda r: r["name"], lambda r: (-len(r["name"]), trusted(r)))  # noqa: B023
        balance = best(own, cents, lambda r: (r["segment"] is None or seg is None or r["segment"] != seg["segment"], recent(r)))  # noqa: B023
        full = lambda r: (r["city"] is not None) + (r["nation_id"] is not None)
        place = best(own, lambda r: full(r) or None, lambda r: (-full(r), recent(r)))  # noqa: B023
        of = lambda r, k: None if r is None else r[k]
        out.append((cluster, len(own), sum(map(stale, own)), of(name, "name"), of(email, "email"), of(seg, "segment"), of(place, "city"), of(place, "nation_id"), None if balance is None else cents(balance), *[of(r, "client_id") for r in (name, email, seg, balance, place)]))
    return sorted(out, key=str)


def clients(seed, n, clusters, repeats=True):
    r = random.Random(seed)
    some = lambda *x: r.choice(x)
    rows = []
    for i in range(n):
        master = some(7, 7, r.randrange(clusters), r.randrange(clusters), None)
        at = some(None, datetime(2024, 1, 1) + timedelta(hours=some(0, 1, 1440, 1441) + r.randrange(3), microseconds=some(0, 1)))
        rows.append((i, master, some("crm", "web", "store", "partner", "other", " ", None), at, some(None, "", " \t", " Ann", "Bobé", "Bob😀", "Christine"), some(None, "", f"e{i}@x", "x@y"), some(None, "\n", "Rome", f"c{i}"), some(None, i % 5), some(None, "", "retail", "public", f"s{i}"), some(None, 1.005, -0.005, i / 3, float("nan"), float("inf"), 1e17), 1, "k", "c", 2))
    if repeats:
        rows += rows[:20] + [(None, None, *rows[0][2:]), (None, None, *rows[1][2:]), (None, 7, *rows[2][2:])] + [rows[5]] * 60
    return rows


@pytest.mark.parametrize(("seed", "n", "clusters", "parts"), [(1, 300, 40, 7), (2, 400, 3, 30), (3, 200, 500, 1), (4, 25, 2, 12)])
def test_golden(spark, seed, n, clusters, parts):
    rows = clients(seed, n, clusters)
    df = spark.createDataFrame(rows, CLIENTS)
    got = sorted((tuple(r) for r in golden.records(df, parts=parts).collect()), key=str)
    names = [f.split()[0] for f in CLIENTS.split(", ")]
    assert got == survivors([dict(zip(names, r)) for r in rows])


def test_golden_small_batches(spark):
    """Clusters that span Arrow batches and files that are read in pieces."""
    rows = clients(9, 500, 4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        got = sorted((tuple(r) for r in golden.records(spark.createDataFrame(rows, CLIENTS), parts=5).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    names = [f.split()[0] for f in CLIENTS.split(", ")]
    assert got == survivors([dict(zip(names, r)) for r in rows])


def test_golden_empty_and_zoned(spark):
    df = spark.createDataFrame([], CLIENTS)
    assert golden.records(df).count() == 0
    rows = clients(5, 60, 5, repeats=False)
    plain = spark.createDataFrame(rows, CLIENTS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    want = sorted(map(str, golden.records(plain).collect()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert sorted(map(str, golden.records(plain).collect())) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(map(str, golden.records(plain.withColumn("updated_at", F.col("updated_at").cast("timestamp"))).collect())) == want


# ---- hard negatives ----

VECTORS = "vec_id long, embedding array<float>, label int, x int, slice string, w int"


def mined_by_hand(rows, anchors, positives=5, negatives=10):
    known = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v) or len(v) != 8:
            continue
        ints = [math.floor(256 * float(np.float32(c))) for c in v]
        key = (label, np.array(ints, "<i4").tobytes())
        if i not in known or key < known[i][0]:
            known[i] = (key, label, ints)
    out = []
    for a, (_, label, q) in known.items():
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, own == label) for i, (_, own, v) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "LEAST_SLICE", 16)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 10)
    r = np.random.default_rng(seed)
    base = r.standard_normal(8) * 0.7
    rows = [(i, [float(c) for c in base + r.standard_normal(8) * (0.5 if i % 3 else 3.0)], int(r.integers(0, 4)), 1, "s", 2) for i in range(400)]
    rows += [(1000 + i, rows[10][1], i % 3, 1, "s", 2) for i in range(60)]  # equal vectors, ties
    rows += [(2000, None, 1, 1, "s", 2), (2001, [], 1, 1, "s", 2), (2002, [1.0] * 7, 1, 1, "s", 2), (2003, [float("nan")] * 8, 1, 1, "s", 2), (2004, [None] + [1.0] * 7, 1, 1, "s", 2)]
    rows += [(2005, [1.0] * 8, None, 1, "s", 2), (None, [1.0] * 8, 1, 1, "s", 2), (2006, [0.0] * 8, 1, 1, "s", 2), (2010, [float("inf")] + [1.0] * 7, 1, 1, "s", 2)]
    rows += [rows[3], (3, rows[4][1], 2, 1, "s", 2), (2020, [float(-c) for c in base], 3, 1, "s", 2)]  # a repeated row, a repeated id
    got = hard_negatives.mined(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0)
    want = mined_by_hand(rows, lambda i: i % 10 == 0)
    assert want and sorted(tuple(x) for x in got.collect()) == want


def test_hard_negatives_few(spark):
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, "s", 2)], VECTORS)
    assert hard_negatives.mined(one, F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.mined(one, F.lit(True), positives=0)


def test_bounds_hold():
    r = np.random.default_rng(5)
    x, q = r.integers(-500, 500, (300, 6)), r.integers(-500, 500, (20, 6))
    edges = np.sort(r.integers(-500, 500, (6, 7)), 1)
    low, high = np.concatenate([np.full((6, 1), -500), edges], 1), np.concatenate([edges - 1, np.full((6, 1), 500)], 1)
    codes = np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(6)], 1)
    least, most = hard_negatives._Bounds(codes, low, high).of(q)
    exact = q @ x.T
    assert (least <= exact).all() and (exact <= most).all() and (most - least).mean() < 500 * 500 * 6


# ---- language identification ----

DOCS = "doc_id long, text string, lang string, source string, held_out int, grams string, worded int"


def grams(text):
    b = text.encode()
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def number(g):
    return len(g) << 40 | int.from_bytes(g, "big")


def test_kernel_by_sets(monkeypatch):
    """Kernel features of whole texts, long ones in pieces, equal those of n-gram sets."""
    monkeypatch.setattr(language, "PIECE", 50)
    r = random.Random(3)
    texts = ["".join(r.choice("abcdeé ÄXY漢") for _ in range(r.choice([0, 1, 2, 3, 40, 400]))) for _ in range(60)] + [None, ""]
    marks = [grams(t) for t in texts[:12] if t]
    known = sorted({number(g) for m in marks for g in m if r.random() < 0.8})
    bits = np.array([[k in {number(g) for g in m} for k in known] for m in marks])
    model = language.Model(np.array(known, np.int64), bits)
    model.languages, model.weights = ["a"], np.concatenate([np.eye(model.root.shape[1]), np.zeros((1, model.root.shape[1]))])
    model.languages = list(range(model.root.shape[1]))
    got = model.scores(pa.array(texts, pa.string()))
    for t, row in zip(texts, got):
        own = {number(g) for g in grams(t or "")} & set(known)
        k = [len(own & {known[i] for i in np.flatnonzero(b)}) / math.sqrt(max(len(own), 1) * b.sum()) for b in bits]
        assert np.allclose(row, np.array(k) @ model.root, atol=1e-4)


def test_language(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(90001, None, "en"), (90002, "", "en"), (90003, " 12 34 ... ", "fr"), (None, "und der die und nicht", "de"), (90004, "the of and " * 200_000, None), (90004, "the of and", None)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).withColumns({"held_out": F.lit(1), "worded": F.lit("x"), "grams": F.lit(2)})
    got = language.identified(both).collect()
    assert len(got) == docs.count() + len(odd)
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in langs]
    assert {r["doc_id"] for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in held)
    assert right >= 0.97 * len(held)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"de", "en", "es", "fr", "und"}
    assert all(by_id[i][0]["lang_pred"] == "und" and by_id[i][0]["score"] == 0 for i in (90001, 90002, 90003))
    assert [r["lang_pred"] for r in by_id[90004]] == ["en", "en"] and not by_id[None][0]["held_out"]
    # Held-out labels teach nothing: without them every prediction is the same.
    unknown = both.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(None)).otherwise(F.col("lang")))
    assert sorted(map(str, language.identified(unknown).collect())) == sorted(map(str, got))


def test_language_nothing_learned(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language.identified(empty).count() == 0
    none = spark.createDataFrame([(1, "words", None, "s", 1, "g", 1)], DOCS)
    assert [tuple(r) for r in language.identified(none).collect()] == [(1, False, "und", 0.0)]
    one = spark.createDataFrame([(i, "some words here", "xx", "s", 1, "g", 1) for i in range(12)], DOCS)
    assert {r["lang_pred"] for r in language.identified(one).collect()} == {"xx"}
