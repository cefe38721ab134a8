"""Search requests: validation, defaults and the plan of one query vector."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import filters

DEFAULT_K, DEFAULT_THRESHOLD, MAX_K = 10, 0.65, 1000


@dataclass
class SearchQuery:
    vector: list[float]
    k: int = DEFAULT_K
    threshold: float | None = None
    filter: dict | None = None

    def __post_init__(self):
        if not 1 <= self.k <= MAX_K:
            raise ValueError(f"k must be 1 to {MAX_K}")
        if self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be 0 to 1")
        if not self.vector or not all(math.isfinite(x) for x in self.vector):
            raise ValueError("the vector must be finite and not empty")


def knn(points: DataFrame, query: SearchQuery, key: str = "key", vector: str = "vector", prefix: str | None = None) -> DataFrame:
    """Exact cosine top-k: filter, then score, then threshold, then the k best (ties by key). Adds `distance`, a similarity."""
    kept = filters.where(points, query.filter, prefix)
    literal = F.array(*[F.lit(float(x)) for x in query.vector])
    scored = kept.withColumn("distance", vectors.cosine(F.col(vector), literal))
    if query.threshold is not None:
        scored = scored.where(F.col("distance") >= query.threshold)
    return scored.orderBy(F.desc_nulls_last("distance"), key).limit(query.k)


def search(points: DataFrame, vector: list[float] | None = None, term: str | None = None, k: int | None = None, threshold: float | None = None, filter: dict | None = None, embedder=None, key: str = "key", column: str = "vector", prefix: str | None = None) -> DataFrame:
    """The request form: a vector or a term for the embedder; k 10 and threshold 0.65 unless given (0 is honoured)."""
    if (vector is None) == (term is None):
        raise ValueError("give either a vector or a term")
    if term is not None:
        if embedder is None:
            raise ValueError("a term needs an embedder")
        vector = embedder.embed([term])[0].tolist()
    return knn(points, SearchQuery(vector, DEFAULT_K if k is None else k, DEFAULT_THRESHOLD if threshold is None else threshold, filter), key, column, prefix)


def flattened(found: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Results as key, distance and the metadata's fields side by side; vectors stay behind."""
    return found.select("key", "distance", f"{metadata}.*")


def shaped(found: DataFrame, digits: int = 4) -> DataFrame:
    """Results for people: the similarity with fixed digits and in percent."""
    return found.select("key", F.format_number("distance", digits).alias("similarity"), F.concat(F.format_number(F.col("distance") * 100, 1), F.lit("%")).alias("percent"))


def summary(found: DataFrame) -> DataFrame:
    """Mean similarity and the best match, of equals the smallest key."""
    return found.agg(F.avg("distance").alias("avg_similarity"), F.min_by("key", F.struct(-F.col("distance"), F.col("key"))).alias("best"))
