"""An approximate k-nearest-neighbour graph and a beam search over it.

Build: neighbour descent. Points start with neighbours from chunks along a few random lines (exact inside a chunk); then, in rounds, every point
introduces its neighbours and those it is a neighbour of to one another, each keeps its best, and rounds end when few change. A point
introduces at most 2 * degree others, drawn by a hash, so a hub's list is bounded; the graph is approximate by design and its recall is measured.
What meets travels as one byte a component, and with the nearness that a new neighbour must exceed, so that only what may enter a list is sent back.

Search: every query holds a beam of its best points. It starts at the best of entry points that cover the space; each step expands the points of
all beams that aren't expanded yet, by a join with the graph, scores neighbours outside the beam, by a join with the vectors, and keeps the
best. A point that was scored and left the beam stays out, as the beam only gets better. A query is done when its beam is all expanded. Queries' vectors are
broadcast in blocks; pairs of ids and scores alone are shuffled. Everything is DataFrames over written tables; the driver sees counts only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..scratch import dropped, written
from .ann import centres_of
from .knn import best, blocks, recall_at_k

DEGREE, LINES, CHUNK, ROUNDS, ENOUGH = 24, 3, 192, 6, 0.002
BEAM, WIDTH = 80, 8
#: Entry points at least and at most, and the bounded sample that they are fitted on and chosen from.
ENTRIES, MAX_ENTRIES, SAMPLE = 16, 1024, 20_000


def units(points: DataFrame) -> DataFrame:
    """(key, unit) of the points that have a direction."""
    return points.select("key", vectors.normalized(F.col("vector")).cast("array<float>").alias("unit")).where("key is not null and unit is not null").where(F.forall("unit", lambda x: ~F.isnan(x)))


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The `degree` nearest distinct neighbours of each key. One shuffle by key serves both steps."""
    once = edges.repartition("key").groupBy("key", "other").agg(F.max("near").alias("near"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("near"), "other"))
    return once.withColumn("r", rank).where(F.col("r") <= degree).drop("r")


def _coded(batches):
    """unit -> code: a byte a component, scaled by the largest."""
    for batch in batches:
        units = batch.column("unit")
        codes = []
        for unit in units:
            x = unit.values.to_numpy(zero_copy_only=False)
            codes.append(np.rint(x * (127 / np.abs(x).max())).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()) if n == "code" else batch.column(n) for n in ("key", "code", "v")], ["key", "code", "v"])


def _met(ids: pa.Array, codes: list[bytes], bars: np.ndarray, degree: int) -> pa.RecordBatch | None:
    """Of points that meet: the best `degree` edges of each that are nearer than its bar."""
    k = min(degree, len(codes) - 1)
    if k < 1:
        return None
    x = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    a, b = np.nonzero(np.take_along_axis(near, top, 1) > bars[:, None])
    b = top[a, b]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(near[a, b])], ["key", "other", "near"])


def _in_line(degree: int):
    """Rows (key, code) in the order of a line -> the best edges inside each CHUNK of them."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def edges(rows: pa.Table):
            return _met(rows.column("key").combine_chunks(), rows.column("code").to_pylist(), np.full(len(rows), -np.inf, np.float32), degree)

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            whole = len(rows) // CHUNK * CHUNK
            for at in range(0, whole, CHUNK):
                yield edges(rows.slice(at, CHUNK))
            held = rows.slice(whole).to_batches()
        if held and (last := edges(pa.Table.from_batches(held))):
            yield last

    return run


def _introduced(degree: int):
    """Rows of meetings (p: other, code, bar) -> the best edges inside each that may enter a list."""

    def run(batches):
        for batch in batches:
            for met in batch.column("p"):
                ids, codes, bars = met.values.flatten()
                found = _met(ids, codes.to_pylist(), bars.to_numpy(zero_copy_only=False), degree)
                if found is not None and found.num_rows:
                    yield found

    return run


def build(points: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(key, other, near): about `degree` nearest neighbours of each point by cosine. Written; equal keys must not repeat."""
    spark = points.sparkSession
    kind = points.schema["key"].dataType.simpleString()
    edge = f"key {kind}, other {kind}, near float"
    own = units(points)
    dim = own.select(F.size("unit")).first()
    if dim is None:
        return spark.createDataFrame([], edge)
    rng = np.random.default_rng(seed)
    lines = [F.array(*[F.lit(float(x)) for x in rng.standard_normal(dim[0])]) for _ in range(LINES)]
    along = own.select("key", "unit", F.array(*[vectors.dot(F.col("unit"), line) for line in lines]).alias("v"))
    coded = written(along.mapInArrow(_coded, f"key {kind}, code binary, v array<double>"))
    found = []
    for i in range(LINES):
        placed = coded.select("key", "code", F.col("v")[i].alias("v")).repartitionByRange("v", "key").sortWithinPartitions("v", "key")
        found.append(placed.select("key", "code").mapInArrow(_in_line(degree), edge))
    graph = written(_best(reduce(DataFrame.unionByName, found), degree))
    n = coded.count()
    for k in range(rounds):
        drawn = lambda by, k=k: F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(by, F.lit(k))))
        back = graph.select(F.col("other").alias("key"), F.col("key").alias("other")).withColumn("r", drawn("other")).where(F.col("r") <= degree).drop("r")
        lists = graph.select("key", "other").unionByName(back).distinct()
        # A full list takes only what is nearer than its last.
        bars = graph.groupBy("key").agg(F.when(F.count("*") >= degree, F.min("near")).otherwise(float("-inf")).cast("float").alias("bar"))
        marked = coded.join(bars, "key", "left").select(F.col("key").alias("other"), "code", F.coalesce("bar", F.lit(float("-inf")).cast("float")).alias("bar"))
        met = lists.join(marked, "other").groupBy("key").agg(F.collect_list(F.struct("other", "code", "bar")).alias("p")).select("p")
        # Each introduced point takes its best few of every meeting; the rest of its list comes from its other meetings.
        offered = met.mapInArrow(_introduced(max(4, degree // 2)), edge)
        fresh = written(_best(graph.unionByName(offered), degree))
        changed = fresh.join(graph, ["key", "other"], "left_anti").count()
        dropped(graph)
        graph = fresh
        if changed <= ENOUGH * n * degree:
            break
    dropped(coded)
    return graph


def links(graph: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(key, others): out and, up to `degree` by nearness, in neighbours, as the search follows them."""
    back = graph.select(F.col("other").alias("key"), F.col("key").alias("other"), "near")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("near"), "other"))).where(F.col("r") <= degree).drop("r")
    return graph.unionByName(back).groupBy("key").agg(F.collect_set("other").alias("others"))


class GraphIndex:
    """The graph and the unit vectors as Parquet below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, points: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 1) -> None:
        own = units(points)
        own.write.parquet(f"{self.path}/units")
        self._entries(self._read("units"), seed).write.parquet(f"{self.path}/entries")
        links(build(points, degree, rounds, seed), degree).write.parquet(f"{self.path}/links")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _entries(self, own: DataFrame, seed: int) -> DataFrame:
        """Points that cover the space: of a bounded sample, those nearest to 2 * sqrt(n) fitted centres, MAX_ENTRIES at most."""
        n = own.count()
        some = own.orderBy(F.xxhash64("key", F.lit(3)), "key").limit(SAMPLE).collect()
        if not some:
            return own
        x = np.array([r["unit"] for r in some])
        centres = centres_of(x, min(MAX_ENTRIES, max(ENTRIES, round(2 * n**0.5))), seed)
        spots = sorted(set((centres @ x.T).argmax(1).tolist()))
        return self.spark.createDataFrame([(some[i]["key"], some[i]["unit"]) for i in spots], own.schema).coalesce(1)

    def beams(self, queries: DataFrame, beam: int = BEAM, width: int = WIDTH) -> DataFrame:
        """(query_id, asked, beam, seen): the final beams, nearest first, and all points that were scored. width: points a query expands in a step."""
        asked = queries.select("query_id", vectors.normalized(F.col("query")).alias("asked")).where("asked is not null")
        return reduce(DataFrame.unionByName, [self._beams(part, beam, width) for part in blocks(written(asked))])

    def _beams(self, asked: DataFrame, beam: int, width: int) -> DataFrame:
        own, graph, told = self._read("units"), self._read("links"), F.broadcast(asked)
        start = self._read("entries").agg(F.collect_list(F.struct("key", "unit")).alias("start"))
        first = asked.join(F.broadcast(start), F.lit(True))
        entry = F.transform("start", lambda s: F.struct((-vectors.dot(s["unit"], F.col("asked"))).alias("far"), s["key"].alias("key"), F.lit(False).alias("done")))
        state = written(first.select("query_id", F.slice(F.array_sort(entry), 1, beam).alias("beam"), F.col("start.key").alias("met")))
        ended, scored = [], []
        while True:
            scored.append(state.select("query_id", "met"))
            # The nearest points of each beam that aren't expanded yet.
            now = state.select("query_id", "beam", F.slice(F.filter("beam", lambda b: ~b["done"]), 1, width)["key"].alias("next"))
            ended.append(now.where(F.size("next") == 0).select("query_id", "beam"))
            going = now.where(F.size("next") > 0)
            steps = going.select("query_id", F.explode("next").alias("key")).join(graph, "key").select("query_id", F.explode("others").alias("key"))
            near = steps.groupBy("query_id").agg(F.collect_set("key").alias("near")).join(going.select("query_id", F.col("beam.key").alias("held")), "query_id")
            new = near.select("query_id", F.explode(F.array_except("near", "held")).alias("key"))
            pairs = new.join(own, "key").join(told, "query_id").select("query_id", (-vectors.dot(F.col("unit"), F.col("asked"))).alias("far"), "key")
            gained = pairs.groupBy("query_id").agg(F.collect_list(F.struct("far", "key", F.lit(False).alias("done"))).alias("gained"))
            both = going.join(gained, "query_id", "left")
            marked = F.transform("beam", lambda b: F.struct(b["far"].alias("far"), b["key"].alias("key"), (b["done"] | F.array_contains("next", b["key"])).alias("done")))
            more = F.coalesce("gained", F.array().cast(state.schema["beam"].dataType))
            state = written(both.select("query_id", F.slice(F.array_sort(F.concat(marked, more)), 1, beam).alias("beam"), more["key"].alias("met")))
            if not state.limit(1).count():
                break
        seen = reduce(DataFrame.unionByName, scored).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("seen"))
        return reduce(DataFrame.unionByName, ended).join(told, "query_id").join(seen, "query_id").select("query_id", "asked", "beam", "seen")

    def search(self, queries: DataFrame, k: int, **options) -> DataFrame:
        """queries (query_id, query) -> query_id, key, distance, rank."""
        return self._top(self.beams(queries, **options), k)

    @staticmethod
    def _top(beams: DataFrame, k: int) -> DataFrame:
        return best(beams.select("query_id", F.explode("beam").alias("b")).select("query_id", "b.key", (-F.col("b.far")).alias("distance")), k)

    def report(self, queries: DataFrame, truth: DataFrame, k: int, **options) -> DataFrame:
        """One row: recall over all queries and the share of the vectors that a query scored."""
        beams = written(self.beams(queries, **options))
        total = self._read("units").count()
        share = beams.agg(F.avg(F.size("seen") / F.lit(max(total, 1))).alias("share_scored"))
        return recall_at_k(self._top(beams, k), truth, k).join(share, F.lit(True)).select("recall", "n_queries", "share_scored")
