"""Approximate search without a graph index: cells (inverted file) and product quantisation. Both rescore exactly; report recall."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import products
from .knn import SEGMENT, best, blocks, segmented

#: Vectors that centres are fitted on, by the smallest key hashes; a bound that doesn't depend on the collection.
FIT_ROWS = 20_000


def _sample(points: DataFrame) -> np.ndarray:
    """Unit vectors of at most FIT_ROWS points."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0)
    some = points.select("key", "vector").where(sound).orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("vector").toArrow()
    found = list(products.matrices(some.column("vector")))
    if not found:
        return np.zeros((0, 0))
    x = max((x for _, x in found), key=len).astype(np.float64)  # vectors of another length than most have no part in the fit
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres_of(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres: seeded by distance, then Lloyd's steps. With fewer rows than k, the rows themselves."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    found = x[[rng.integers(len(x))]]
    near = ((x - found[0]) ** 2).sum(1)
    while len(found) < k:
        spot = rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))
        found = np.vstack([found, x[spot]])
        near = np.minimum(near, ((x - x[spot]) ** 2).sum(1))
    for _ in range(rounds):
        label = ((found**2).sum(1) - 2 * x @ found.T).argmin(1)
        for c in np.unique(label):
            found[c] = x[label == c].mean(0)
    return found


def _dealt(points: DataFrame, name: str, kind: str, deal) -> DataFrame:
    """points with a column made from the unit vectors of a batch; null where there is none. deal: matrix -> list of values."""

    def run(batches):
        for batch in batches:
            values: list = [None] * batch.num_rows
            for at, x in products.matrices(batch.column("vector")):
                length = np.linalg.norm(x.astype(np.float64), axis=1)
                good = length > 0
                for i, v in zip(at[good].tolist(), deal(x[good] / length[good, None])):
                    values[i] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, to_arrow_type(made.dataType))], [*batch.schema.names, name])

    made = T.StructType.fromDDL(f"{name} {kind}")[0]
    return points.mapInArrow(run, T.StructType([*points.schema.fields, made]))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre by squared distance, ties to the smaller."""
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def with_cells(points: DataFrame, cells: int, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """points with `cell`, a column to partition the collection by, and the cells' centres (of unit vectors)."""
    centres = centres_of(_sample(points), cells, seed)
    of = lambda x: _nearest(x, centres).tolist() if x.shape[1] == centres.shape[1] else [None] * len(x)
    return _dealt(points, "cell", "int", of), centres


def with_probes(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(query_id, query, cells): the cells of the nearest centres by product."""

    def near(x: np.ndarray) -> list:
        fits = x.shape[1] == centres.shape[1]
        return np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].tolist() if fits else [None] * len(x)

    asked = queries.select("query_id", F.col("query").alias("vector"))
    return _dealt(asked, "cells", "array<int>", near).where("cells is not null").withColumnRenamed("vector", "query")


def cell_search(points: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """Exact cosine inside each query's `probes` nearest cells; blocks of points are of one cell and meet the queries that look into it."""
    dealt = products.spread(points.select("key", "vector", "cell").where("cell is not null"), "cell")
    found = lambda part: products.nearest(dealt, with_probes(part, centres, probes), k, group="cell")
    return reduce(DataFrame.unionByName, [best(found(part), k) for part in blocks(queries)])


def product_codes(points: DataFrame, dim: int, parts: int, k: int = 16, seed: int = 1) -> tuple[DataFrame, list[np.ndarray]]:
    """points with `codes`, the nearest centre of each sub-vector of the unit vector, and the codebooks."""
    width = dim // parts
    sample = _sample(points)
    books = [centres_of(sample[:, p * width : (p + 1) * width], k, seed + p) for p in range(parts)]

    def code(x: np.ndarray) -> list:
        if x.shape[1] != dim:
            return [None] * len(x)
        return np.stack([_nearest(x[:, p * width : (p + 1) * width], b) for p, b in enumerate(books)], 1).tolist()

    return _dealt(points, "codes", "array<int>", code).where("codes is not null"), books


def product_search(coded: DataFrame, books: list[np.ndarray], queries: DataFrame, k: int, oversampling: int = 4) -> DataFrame:
    """Products with the vectors that the codes stand for rank k * oversampling candidates per query in each segment of about knn.SEGMENT rows;
    exact cosine rescores them. By segment their share, and so the recall, doesn't fall as the table grows."""
    width = sum(b.shape[1] for b in books)

    def estimate(asked: products.Side, point: products.Side) -> np.ndarray:
        if "stood" not in point.kept:
            codes = point.more["codes"]
            point.kept["stood"] = np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], 1).astype(np.float32)
        return asked.unit[:, :width] @ point.kept["stood"].T

    parts = products.spread(segmented(coded.select("key", "vector", "codes")), "segment", whole=True)
    found = lambda part: products.nearest(parts, part, k, group="segment", near=estimate, take=k * oversampling, extra=["codes"], rows=4 * SEGMENT)
    return reduce(DataFrame.unionByName, [best(found(part), k) for part in blocks(queries)])
