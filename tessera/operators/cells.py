"""An approximate index on disk: points in files by the cell of a two-level centre tree.

Centres are fitted once, on a bounded sample, and kept beside the points; later points are dealt to the same cells and written as deltas, with nothing
fitted again. Files are partitioned by cell. A search ranks the leaves for each query, reads only the partitions of the cells that some query asks
for, and scores exactly inside each query's own cells. Recall is measured, not assumed: `report` returns it with the share of the vectors scored
and the files read.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written
from . import products
from .ann import _sample, centres_of, with_probes
from .knn import best, blocks


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have one, and their places."""
    x = np.full((len(column), dim), np.nan)
    for at, rows in products.matrices(column):
        if rows.shape[1] == dim:
            x[at] = rows
    length = np.linalg.norm(x, axis=1)
    good = np.flatnonzero(np.isfinite(length) & (length > 0))
    return x[good] / length[good, None], good


class CellIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- building ----

    def build(self, points: DataFrame, cells: int, seed: int = 1) -> None:
        """points (key, vector): fit about `cells` leaves below their square root of branches, and write the first part."""
        sample = _sample(points)
        if not len(sample):
            raise ValueError("no vector to fit on")
        branches = centres_of(sample, max(1, round(cells**0.5)), seed)
        own = (sample @ branches.T).argmax(1)
        leaves, parent = [], []
        for b in range(len(branches)):
            inside = sample[own == b]
            share = max(1, round(cells * len(inside) / len(sample)))
            found = centres_of(inside, share, seed + 1 + b) if len(inside) else branches[[b]]
            leaves.append(found)
            parent += [b] * len(found)
        tree = {"dim": int(sample.shape[1]), "leaves": np.concatenate(leaves).tolist(), "parent": parent}
        self.spark.createDataFrame([(json.dumps(tree),)], "tree string").coalesce(1).write.text(f"{self.path}/tree")
        self.add(points)

    def _tree(self) -> tuple[np.ndarray, int]:
        tree = json.loads(self.spark.read.text(f"{self.path}/tree", wholetext=True).first()[0])
        return np.array(tree["leaves"]), tree["dim"]

    def add(self, points: DataFrame) -> None:
        """Deal points to the fitted cells and append them; points without a direction have no cell and stay out."""
        leaves, dim = self._tree()

        def deal(batches):
            for batch in batches:
                x, good = _units(batch.column("vector"), dim)
                cell = (x @ leaves.T).argmax(1) if len(x) else np.zeros(0, np.int64)
                kept = batch.take(pa.array(good))
                yield pa.RecordBatch.from_arrays([kept.column("key"), kept.column("vector"), pa.array(cell.astype(np.int32))], ["key", "vector", "cell"])

        key, kind = (points.schema[c].dataType.simpleString() for c in ("key", "vector"))
        dealt = points.select("key", "vector").mapInArrow(deal, f"key {key}, vector {kind}, cell int")
        # A hot cell is spread over several writers.
        spread = dealt.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(8)))
        spread.repartition("cell", "_s").drop("_s").write.mode("append").partitionBy("cell").parquet(f"{self.path}/points")

    # ---- searching ----

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points")

    def asked(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, query, cells): each query with its nearest cells."""
        leaves, dim = self._tree()
        return with_probes(queries.where(F.size("query") == dim), leaves, probes)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """queries (query_id, query) -> query_id, key, distance, rank: exact inside the `probes` nearest cells."""
        return self._scored(written(self.asked(queries, probes)), k)

    def _wanted(self, asked: DataFrame) -> list[int]:
        """Cells that some query asks for; there are at most as many as leaves."""
        return sorted(r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect())

    def _scored(self, asked: DataFrame, k: int) -> DataFrame:
        near = self.points().where(F.col("cell").isin(self._wanted(asked)))
        return reduce(DataFrame.unionByName, [best(products.nearest(near, part, k, group="cell"), k) for part in blocks(asked)])

    def files(self, cells: list[int] | None = None) -> int:
        """Files below the partitions of these cells, or of all."""
        at = self.points()
        at = at if cells is None else at.where(F.col("cell").isin(cells))
        return at.select("_metadata.file_path").distinct().count()

    def report(self, queries: DataFrame, truth: DataFrame, k: int, probes: int) -> DataFrame:
        """One row: recall over all queries, share of the vectors scored by a query, files read and files in all."""
        from .knn import recall_at_k

        asked = written(self.asked(queries, probes))
        sizes = self.points().groupBy("cell").agg(F.count("*").alias("n"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        scored = asked.select("query_id", F.explode("cells").alias("cell")).join(sizes, "cell", "left").agg(F.sum("n").alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
        share = (scored["pairs"] or 0) / (total * scored["queries"]) if total and scored["queries"] else 0.0
        found = recall_at_k(self._scored(asked, k), truth, k)
        return found.select("recall", "n_queries").withColumns({"share_scored": F.lit(float(share)), "files_read": F.lit(self.files(self._wanted(asked))).cast("long"), "files": F.lit(self.files()).cast("long")})
