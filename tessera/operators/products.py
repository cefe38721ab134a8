"""Pairs of points and queries as matrix products: both sides are packed into blocks, blocks meet in tasks, and a task keeps each query's best.

A task sends on k rows for each query, whatever the number of points it has read. The products only choose; the rows chosen are scored again term by
term, as dot / sqrt(|a|^2 * |b|^2), so that equal vectors get equal scores and ties go by key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import written

#: Rows of a block of points and of queries.
ROWS, ASKED = 2048, 1024


def slack(dim: int) -> float:
    """More than the error of a product of unit vectors in single precision."""
    return 2e-7 * (dim + 8)


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def matrices(column: pa.Array):
    """(places, matrix) of the rows of each length that hold finite numbers only."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(length) - length
    for n in np.unique(length[length > 0]):
        at = np.flatnonzero(length == n)
        x = flat[starts[at][:, None] + np.arange(n)]
        x = x if x.dtype == np.float32 else x.astype(np.float64)
        good = np.isfinite(x).all(1)
        if good.any():
            yield at[good], x[good]


def _pack(group: str | None, extra: list[str], rows: int):
    """Rows (id, vector, group, extra arrays of one length each) to blocks of at most `rows` of one group and one length."""

    def run(batches):
        held: dict[int, list] = {}
        now = None

        def block(dim, parts):
            ids = pa.concat_arrays([p[0] for p in parts])
            x = np.concatenate([p[1] for p in parts])
            more = [np.concatenate([p[2][i] for p in parts]) for i in range(len(extra))]
            one = [pa.array([now], pa.int64()), pa.array([dim], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(one + [pa.array([m.tobytes()], pa.binary()) for m in more], ["grp", "dim", "ids", "data", *extra])

        def flush():
            for dim, parts in held.items():
                yield block(dim, parts)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = pc.fill_null(batch.column("grp").cast(pa.int64()), -1).to_numpy(zero_copy_only=False) if group else np.zeros(batch.num_rows, np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if groups[lo] != now:
                    yield from flush()
                    now = int(groups[lo])
                part = batch.slice(lo, hi - lo)
                for at, x in matrices(part.column("vector")):
                    more = []
                    for name in extra:
                        column = part.column(name).take(pa.array(at))
                        more.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1).astype(np.int32))
                    ids, dim = part.column("id").take(pa.array(at)), x.shape[1]
                    while len(x):
                        room = rows - sum(len(p[1]) for p in held.get(dim, []))
                        held.setdefault(dim, []).append((ids[:room], x[:room], [m[:room] for m in more]))
                        ids, x, more = ids[room:], x[room:], [m[room:] for m in more]
                        if sum(len(p[1]) for p in held[dim]) >= rows:
                            yield block(dim, held.pop(dim))
        yield from flush()

    return run


def _packed(df: DataFrame, id_: str, vector: str, group: str | None, extra: list[str], rows: int) -> DataFrame:
    kind = df.schema[id_].dataType.simpleString()
    taken = df.select(F.col(id_).alias("id"), F.col(vector).alias("vector"), *([F.col(group).alias("grp")] if group else []), *extra)
    schema = ", ".join(["grp long", "dim int", f"ids array<{kind}>", "data binary", *[f"{e} binary" for e in extra]])
    return taken.mapInArrow(_pack(group, extra, rows), schema).withColumn("at", F.monotonically_increasing_id())


def spread(points: DataFrame, group: str | None = None, whole: bool = False) -> DataFrame:
    """points dealt to all cores by key, or by group if groups are to stay whole; rows of a group side by side."""
    n = 2 * points.sparkSession.sparkContext.defaultParallelism
    dealt = points.repartition(n, group if whole else "key")
    return dealt.sortWithinPartitions(group, "key") if group else dealt


class Side:
    """A block in a task."""

    def __init__(self, batch, i: int, prefix: str, extra: list[str]):
        cell = lambda name: batch.column(prefix + name)[i]
        self.dim, self.group = cell("dim").as_py(), cell("grp").as_py()
        self.ids = cell("ids").values
        data = cell("data").as_buffer()
        self.x = np.frombuffer(data, np.float32 if data.size == 4 * self.dim * len(self.ids) else np.float64).reshape(-1, self.dim).astype(np.float64)
        self.columns = np.ascontiguousarray(self.x.T)
        self.square = np.zeros(len(self.x))
        for c in self.columns:
            self.square += c * c
        self.blank = ~((self.square > 0) & np.isfinite(self.square))
        self.unit = (self.x / np.sqrt(np.where(self.blank, 1, self.square))[:, None]).astype(np.float32)
        self.more = {e: np.frombuffer(cell(e).as_buffer(), np.int32).reshape(len(self.x), -1) for e in extra}
        self.kept: dict = {}

    def signs(self) -> np.ndarray:
        if "signs" not in self.kept:
            self.kept["signs"] = np.where(self.x > 0, np.float32(1), np.float32(-1))
        return self.kept["signs"]


def cosines(asked: Side, point: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    total = np.zeros(len(i))
    for a, b in zip(asked.columns, point.columns):
        total += a[i] * b[j]
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return np.clip(total / np.sqrt(asked.square[i] * point.square[j]), -1, 1)


def _keys(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys that sort as Spark's do, and which are null."""
    none = ids.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(ids.type):
        return pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), none
    if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type):
        return np.array(pc.fill_null(ids, "").to_pylist(), dtype=str), none
    return np.array(ids.to_pylist()), none


class Heads:
    """The best `k` (one number, or one a query) rows of each query of a block, by score from high to low, then by key."""

    def __init__(self, n: int, k):
        self.k = np.broadcast_to(np.asarray(k), (n,))
        self.rows: tuple | None = None
        self.bound = np.full(n, -np.inf)

    def add(self, q, rank, score, key, none) -> None:
        new = (q, rank, score, key, none)
        rows = new if self.rows is None else tuple(np.concatenate(p) for p in zip(self.rows, new))
        order = np.lexsort((rows[3], rows[4], -rows[1], rows[0]))
        rows = tuple(r[order] for r in rows)
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(len(rows[0])) - first
        self.rows = tuple(r[place < self.k[rows[0]]] for r in rows)
        last = place == self.k[rows[0]] - 1
        self.bound[rows[0][last]] = rows[1][last]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def _inside(asked: Side, point: Side) -> np.ndarray | None:
    """The queries of a block that look into the cell of a block of points; None for all."""
    return np.flatnonzero((asked.more["cells"] == point.group).any(1)) if "cells" in asked.more else None


def _met(batches, point_extra: list[str], asked_extra: list[str]):
    """(number of the query block, its rows, the block of points) for each meeting. A block is decoded once."""
    asked: dict[int, Side] = {}
    at, point = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column("p_at")[i].as_py() != at:
                at, point = batch.column("p_at")[i].as_py(), Side(batch, i, "p_", point_extra)
            number = batch.column("q_at")[i].as_py()
            if number not in asked:
                asked[number] = Side(batch, i, "q_", asked_extra)
            if asked[number].dim == point.dim and len(point.x) and len(asked[number].x):
                yield number, asked[number], point


def _search(k: int, threshold: float | None, near: Callable | None, take: int, point_extra: list[str], asked_extra: list[str], key_type: pa.DataType):
    """Each query's k best of the points that a task meets. near: scores of a first phase; of each block of points only the `take` best by it count."""

    def run(batches):
        heads: dict[int, Heads] = {}
        sides: dict[int, Side] = {}
        for number, asked, point in _met(batches, point_extra, asked_extra):
            head = heads.setdefault(number, Heads(len(asked.x), k))
            sides[number] = asked
            rows = _inside(asked, point)
            if rows is not None and not len(rows):
                continue
            unit = asked.unit if rows is None else asked.unit[rows]
            score = unit @ point.unit.T
            score[:, point.blank] = -np.inf
            if near is not None and score.shape[1] > take:
                first = near(asked, point)
                cut = _kth(first, take)[:, None]
                open_ = first < cut
                # Of equal estimates at the cut the smallest keys stay; blocks are in the order of keys.
                tied = first == cut
                open_ |= tied & (np.cumsum(tied, axis=1) > take - (first > cut).sum(1)[:, None])
                score[open_] = -np.inf
            bound = head.bound if rows is None else head.bound[rows]
            fresh = np.flatnonzero(~np.isfinite(bound))
            bound = bound.copy()
            if len(fresh) and score.shape[1] > k:
                bound[fresh] = _kth(score[fresh], k)  # of this block
            bound = np.where(np.isfinite(bound), bound - slack(point.dim), -2.0)
            if threshold is not None:
                bound = np.maximum(bound, threshold - slack(point.dim))
            i, j = _hits(score >= bound[:, None].astype(np.float32))
            i = i if rows is None else rows[i]
            exact = cosines(asked, point, i, j)
            good = ~np.isnan(exact) & ~asked.blank[i]
            if threshold is not None:
                good &= exact >= threshold
            i, j, exact = i[good], j[good], exact[good]
            if len(i):
                if "keys" not in point.kept:
                    point.kept["keys"] = _keys(point.ids)
                key, none = point.kept["keys"]
                head.add(i, exact, exact, key[j], none[j])
        for number, head in heads.items():
            if head.rows is not None:
                q, _, score, key, none = head.rows
                yield pa.RecordBatch.from_arrays([sides[number].ids.take(pa.array(q)), pa.array(key.tolist(), key_type, mask=none), pa.array(score)], ["query_id", "key", "distance"])

    return run


def _pairs(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Blocks of points beside all blocks of queries. A set of queries is bounded (knn.blocks)."""
    left = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return left.join(F.broadcast(right), F.lit(True))


def asked_blocks(queries: DataFrame, extra: list[str] | None = None) -> DataFrame:
    parts = -(-5 * queries.count() // (4 * ASKED)) or 1  # most parts fit a block
    taken = queries.where("query_id is not null").repartition(parts, "query_id")
    return _packed(taken, "query_id", "query", None, extra or [], ASKED)


def _arrow(df: DataFrame, name: str) -> tuple[pa.DataType, str]:
    return to_arrow_type(df.schema[name].dataType), df.schema[name].dataType.simpleString()


def nearest(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, group: str | None = None, near: Callable | None = None, take: int = 0, extra: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """points (key, vector), queries (query_id, query) -> query_id, key, distance: at least each query's k best, from every task.

    With queries' `cells` (array<int>), only points whose `group` is among them. With near, see _search; then groups are its blocks."""
    kind, name = _arrow(points, "key")
    asked_extra = ["cells"] if "cells" in queries.columns else []
    left = _packed(points, "key", "vector", group, extra or [], rows)
    run = _search(k, threshold, near, take, extra or [], asked_extra, kind)
    return _pairs(left, asked_blocks(queries, asked_extra)).mapInArrow(run, f"query_id {_arrow(queries, 'query_id')[1]}, key {name}, distance double")


# ---- sign bits over the whole table ----


def _hamming(asked: Side, point: Side) -> np.ndarray:
    return ((asked.dim - asked.signs() @ point.signs().T) / 2).astype(np.int32)


def unlike(asked: Side, point: Side) -> np.ndarray:
    """Minus the Hamming distance of sign bits, as a first phase."""
    return asked.signs() @ point.signs().T


def _counted(take: int):
    """(query_id, bits, n): points at each Hamming distance, up to the distance at which this task alone holds `take`."""

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        sides: dict[int, Side] = {}
        for number, asked, point in _met(batches, [], []):
            sides[number] = asked
            n, wide = len(asked.x), asked.dim + 1
            flat = _hamming(asked, point) + (np.arange(n) * wide)[:, None]
            counts[number] = counts.get(number, 0) + np.bincount(flat.ravel(), minlength=n * wide).reshape(n, wide)
        for number, found in counts.items():
            before = np.cumsum(found, axis=1) - found
            q, bits = np.nonzero((found > 0) & (before < take))
            yield pa.RecordBatch.from_arrays([sides[number].ids.take(pa.array(q)), pa.array(bits.astype(np.int32)), pa.array(found[q, bits])], ["query_id", "bits", "n"])

    return run


def _second(k: int, key_type: pa.DataType):
    """The k best by cosine below each query's distance, and at the distance itself the first keys, as many as are missing."""

    def run(batches):
        heads: dict[int, tuple[Heads, Heads]] = {}
        sides: dict[int, Side] = {}
        for number, asked, point in _met(batches, [], ["cut"]):
            cut, need = asked.more["cut"].T
            sides[number] = asked
            sure, edge = heads.setdefault(number, (Heads(len(asked.x), k), Heads(len(asked.x), need)))
            bits = _hamming(asked, point)
            key, none = point.kept.setdefault("keys", None) or _keys(point.ids)
            point.kept["keys"] = (key, none)
            score = asked.unit @ point.unit.T
            for head, mask in ((sure, (bits < cut[:, None]) & (score >= (sure.bound - slack(point.dim))[:, None].astype(np.float32))), (edge, bits == cut[:, None])):
                i, j = _hits(mask)
                exact = cosines(asked, point, i, j)
                if head is sure:
                    good = ~np.isnan(exact)
                    i, j, exact = i[good], j[good], exact[good]
                head.add(i, exact if head is sure else np.zeros(len(i)), exact, key[j], none[j])
        for number, pair in heads.items():
            for head in pair:
                if head.rows is not None:
                    q, _, score, key, none = head.rows
                    need = np.zeros(len(q), np.int32) if head is pair[0] else sides[number].more["cut"][q, 1]
                    yield pa.RecordBatch.from_arrays([sides[number].ids.take(pa.array(q)), pa.array(key.tolist(), key_type, mask=none), pa.array(score), pa.array(need)], ["query_id", "key", "distance", "need"])

    return run


def signed(points: DataFrame, queries: DataFrame, k: int, take: int) -> DataFrame:
    """query_id, key, distance: the k best by cosine, at least, of each query's `take` points of the smallest Hamming distance (ties by key).

    Counts per distance come first; they tell at which distance the take-th point lies, so that no list of `take` is kept or sent."""
    kind, name = _arrow(points, "key")
    asked_kind = _arrow(queries, "query_id")[1]
    left = _packed(points, "key", "vector", None, [], ROWS)
    counts = _pairs(left, asked_blocks(queries)).mapInArrow(_counted(take), f"query_id {asked_kind}, bits int, n long")
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("bits"))
    run = counts.groupBy("query_id", "bits").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    last = run.where(F.col("upto") - F.col("n") < take).groupBy("query_id").agg(F.max("bits").alias("bits"), F.max_by(F.lit(take) - F.col("upto") + F.col("n"), "bits").alias("need"))
    cut = last.select("query_id", F.array(F.col("bits"), F.col("need").cast("int")).alias("cut"))
    held = queries.join(written(cut), "query_id")
    found = _pairs(left, asked_blocks(held, ["cut"])).mapInArrow(_second(k, kind), f"query_id {asked_kind}, key {name}, distance double, need int")
    found = written(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("key").asc_nulls_last()))
    edge = found.where("need > 0").withColumn("r", rank).where(F.col("r") <= F.col("need"))
    return found.where("need = 0").unionByName(edge.select(found.columns)).select("query_id", "key", "distance").where(~F.isnan("distance"))
