"""Embedding in small parts, once for each text."""

import hashlib
import os

import numpy as np

from tessera.functions.embed import HashingEmbedder, generate
from tessera.operators.imports import generate_and_store
from tessera.operators.store import VectorTable


def noting(path):
    """An embedder that leaves the number of texts of each call as a line of a file of its worker."""

    class Noting(HashingEmbedder):
        def embed(self, texts):
            with open(f"{path}/{os.getpid()}", "a") as f:
                f.write(f"{len(texts)}\n")
            return HashingEmbedder.embed(self, texts)

    return Noting(8)


def calls(path):
    return [int(n) for f in path.iterdir() for n in f.read_text().split()]


def test_hashing():
    texts = ["", "one", "One two ONE three", "ß ÄÖ ß " + "x" * 100 + " " + "x" * 100, " \n"]
    want = np.zeros((len(texts), 16))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            want[i, h % 16] += 1 if h >> 63 else -1
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.array_equal(HashingEmbedder(16).embed(texts), want / np.where(length > 0, length, 1))


def test_small_parts(spark, tmp_path):
    rows = spark.range(3000).selectExpr("id", "concat('text ', id) as text").coalesce(1)
    assert generate(rows, "id", "text", noting(str(tmp_path))).count() == 3000
    assert sum(calls(tmp_path)) == 3000 and max(calls(tmp_path)) <= 256


def test_embedded_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    rows = spark.range(500).selectExpr("id", "concat('text ', id) as text").unionByName(spark.createDataFrame([(1, "a"), (2, " "), (3, None), (None, "x"), (900, "\t")], "id long, text string"))
    table = VectorTable(spark, str(tmp_path / "t"), 8)
    assert generate_and_store(rows, "id", "text", table, noting(str(notes))) == 500 and sum(calls(notes)) == 500
    got = {r["key"]: (r["metadata"]["text"], [round(x, 6) for x in r["vector"]]) for r in table.read().collect()}
    assert len(got) == 500 and got["1"][0] == "a" and got["2"][0] == "text 2"
    own = HashingEmbedder(8)
    assert all(v == [round(float(x), 6) for x in own.embed([t])[0].astype(np.float32)] for t, v in got.values())
    assert generate_and_store(rows.where("false"), "id", "text", VectorTable(spark, str(tmp_path / "u"), 8)) == 0
