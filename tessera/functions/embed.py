"""Embedders: the extension point that turns texts into vectors, run over Arrow batches."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITEMS = 1000
#: Texts that an embedder gets at once; words of at most so many letters whose hashes a worker remembers, and how many of them.
TEXTS, SHORT, WORDS = 256, 40, 1 << 16


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


_remembered = lru_cache(WORDS)(_hash)


class HashingEmbedder:
    """Deterministic: signed hashed words, L2-normalised. Needs no model or network."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            found = np.array([_remembered(w) if len(w) <= SHORT else _hash(w) for w in text.lower().split()], np.uint64)
            sign = np.where(found >> np.uint64(63), 1.0, -1.0)
            out[i] = np.bincount((found % np.uint64(self.dim)).astype(np.int64), sign, self.dim)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def _embed(embedder: Embedder, key_type: pa.DataType | None = None):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):  # a worker holds a few texts as Python strings
                batch = whole.slice(at, TEXTS)
                v = embedder.embed([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], ["key", "vector"])

    return run


def generate(df: DataFrame, key: str, body: str, embedder: Embedder | None = None) -> DataFrame:
    """(key, vector) of rows with a key and a text that isn't blank."""
    rows = df.select(F.col(key).alias("key"), F.col(body).alias("body")).where(F.col("key").isNotNull() & F.coalesce(F.col("body").rlike(r"\S"), F.lit(False)))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_embed(embedder or HashingEmbedder()), f"key {kind}, vector array<float>")


def validated_items(df: DataFrame, limit: int = MAX_ITEMS) -> DataFrame:
    """Rejects an empty or too long request, and items without key or content."""
    n = df.limit(limit + 1).count()
    if not 1 <= n <= limit:
        raise ValueError(f"1 to {limit} items")
    if df.where("key is null or key = '' or content is null or content = ''").limit(1).count():
        raise ValueError("an item needs a key and content")
    return df
