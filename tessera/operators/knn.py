"""Nearest neighbours for many queries: exact and two-phase quantised plans; recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import metrics, products

#: Query vectors that one plan may broadcast; larger sets go in blocks of this size.
QUERY_BLOCK = 32_768
#: Rows, on average, of a segment that proposes candidates of its own.
SEGMENT = 1024


def best(scored: DataFrame, k: int, query: str = "query_id", key: str = "key") -> DataFrame:
    """The k rows of the highest distance per query, ties by key, with rank. Spark limits each task's rows per group first."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("distance"), F.col(key).asc_nulls_last()))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def blocks(queries: DataFrame) -> list[DataFrame]:
    """queries in hash parts of query_id of about QUERY_BLOCK rows; rows of one query_id stay together. The driver sees their number only."""
    n = -(-queries.count() // QUERY_BLOCK)
    if n <= 1:
        return [queries]
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return [queries.where(part == i) for i in range(n)]


def knn_sql(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """points (key, vector), queries (query_id, query) -> query_id, key, distance, rank. Exact; the same plan as knn_batched."""
    return knn_batched(points, queries, k, threshold)


def knn_pairs(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The same rows by expressions over all pairs, some microseconds each: for small tables."""
    left = points.select("key", vectors.normalized(F.col("vector")).alias("unit")).where("unit is not null")
    right = queries.select("query_id", vectors.normalized(F.col("query")).alias("asked")).where("asked is not null")
    pairs = left.join(F.broadcast(right), F.lit(True))
    scored = pairs.select("query_id", "key", vectors.dot(F.col("unit"), F.col("asked")).alias("distance")).where("distance is not null")
    if threshold is not None:
        scored = scored.where(F.col("distance") >= threshold)
    return best(scored, k)


def knn_batched(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Exact nearest neighbours by matrix products over blocks of both sides. Vectors that are null, zero or hold null or non-finite components take no part."""
    dealt = products.spread(points.select("key", "vector"))
    return reduce(DataFrame.unionByName, [best(products.nearest(dealt, part, k, threshold), k) for part in blocks(queries)])


def knn_two_phase(points: DataFrame, queries: DataFrame, dim: int, k: int, oversampling: int = 2) -> DataFrame:
    """Candidates by Hamming distance of sign bits (k * oversampling, ties by key), then exact cosine. Approximate: report recall."""
    dealt = products.spread(points.select("key", "vector").where(F.size("vector") == dim))
    return reduce(DataFrame.unionByName, [best(products.signed(dealt, part.where(F.size("query") == dim), k, k * oversampling), k) for part in blocks(queries)])


def segmented(points: DataFrame) -> DataFrame:
    """points with `segment`, a hash of the key that leaves about SEGMENT rows to each."""
    n = max(1, -(-points.count() // SEGMENT))
    return points.withColumn("segment", F.pmod(F.xxhash64("key"), F.lit(n)))


def knn_two_phase_segments(points: DataFrame, queries: DataFrame, dim: int, k: int, oversampling: int = 2) -> DataFrame:
    """knn_two_phase with k * oversampling candidates of each segment of about SEGMENT rows: their share, and so the recall, doesn't fall as the table grows."""
    parts = products.spread(segmented(points.select("key", "vector").where(F.size("vector") == dim)), "segment", whole=True)
    found = lambda part: products.nearest(parts, part, k, group="segment", near=products.unlike, take=k * oversampling, rows=4 * SEGMENT)
    return reduce(DataFrame.unionByName, [best(found(part), k) for part in blocks(queries)])


def int8_bounds(points: DataFrame, quantile: float = 0.99) -> DataFrame:
    """One row (low, high): clip bounds of all components, the middle `quantile` of them by exact ranks."""
    tail = round((1 - quantile) / 2, 12)
    return metrics.nearest_ranks(points.select(F.explode("vector").alias("x")), "x", {"low": tail, "high": round(1 - tail, 12)})


def recall_at_k(results: DataFrame, truth: DataFrame, k: int, groups: list[str] | None = None) -> DataFrame:
    """Mean over queries of |top-k ∩ truth| / min(k, |truth|); queries without truth don't count. Frames: query_id, key (and groups)."""
    groups = groups or []
    got = results.groupBy(*groups, "query_id").agg(F.collect_set("key").alias("got"))
    true = truth.groupBy("query_id").agg(F.collect_set("key").alias("true"))
    each = got.join(true, "query_id").withColumn("recall", F.size(F.array_intersect("got", "true")) / F.least(F.lit(k), F.size("true")))
    return each.groupBy(*groups).agg(F.avg("recall").alias("recall"), F.count("*").alias("n_queries"))


def centroids(points: DataFrame, by: str) -> DataFrame:
    """(by, pos, mean): component means per group."""
    return points.select(by, F.posexplode("vector").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def similarity_to(points: DataFrame, literal: Column) -> DataFrame:
    return points.withColumn("distance", vectors.cosine(F.col("vector"), literal))


def sample_queries(points: DataFrame, n: int) -> DataFrame:
    """The first n points by key as query vectors."""
    return points.orderBy("key").limit(n).select(F.col("key").alias("query_id"), F.col("vector").alias("query"))
