"""Shared helpers: size-checked joins, components and byte-level hashing."""

from __future__ import annotations

import ctypes
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import dropped, folder, written

__all__ = ["dropped", "folder", "written"]

#: Bytes of a lookup side that may be broadcast. They are counted first; beyond them a shuffle join is used.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(*done: DataFrame) -> None:
    """Delete written tables that are no longer needed."""
    for df in done:
        dropped(df)


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, roughly."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(column) + 16
    if isinstance(kind, T.ArrayType):
        fields = len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType)):
            return F.octet_length(F.to_json(column))
        return F.size(column) * (8 * fields + 16) + 16
    return F.lit(8 * len(kind.fields) + 16 if isinstance(kind, T.StructType) else 8)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a written lookup side: broadcast it if its counted bytes are few, else shuffle (AQE splits skewed keys)."""
    width = reduce(Column.__add__, [F.coalesce(_width(F.col(f.name), f.dataType), F.lit(8)) for f in small.schema.fields])
    if (small.agg(F.sum((width + 16).cast("long"))).first()[0] or 0) <= most:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def _forest(schema_names: tuple[str, str]):
    def run(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def flush():
            pairs = [(k, find(k)) for k in list(parent)]
            pairs = [(a, b) for a, b in pairs if a != b]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], list(schema_names))

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:
                yield flush()
        yield flush()

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per node of an edge; component is the smallest node.

    Alternating large-star and small-star steps over written tables. Each task first reduces its own edges to a
    forest, so chains and dense groups shrink before they are shuffled. Loops and repeated edges are harmless.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b and a is not null and b is not null")
    cur = written(edges.mapInArrow(_forest(("a", "b")), "a long, b long"))
    before, last = None, cur
    while True:  # every round but the last hangs some node lower
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        cur = written(small)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        dropped(last)
        last = cur
    labelled = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labelled.unionByName(labelled.select(F.col("component").alias("node"), "component").distinct())


def trimmed(run):
    """A batch function whose worker gives freed memory back to the system when its task ends; workers outlive tasks and stand idle beside others."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return go


# ---- byte-level hashing, vectorised over the texts of an Arrow batch ----

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, 1 << 18), base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def chunks(column: pa.Array, most: int = 1 << 18):
    """Yield (first row, bytes, offsets) of consecutive rows with about `most` bytes; a longer text stands alone. Nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray, hashes: bool = True):
    """Words [^\\x20\\x09-\\x0D]+ of the chunk's texts: starts, ends (bytes), 64-bit hashes of the A-Z-lowered words, and offsets per text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, _U), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offs[:-1][offs[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    per = np.searchsorted(starts, offs)
    if not hashes:
        return starts, ends, None, per
    up, down = _power(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U)), per


def shingles(hashes: np.ndarray, per: np.ndarray, size: int = 5):
    """Hashes of the word shingles of each text, in order, with offsets per text; a text of fewer words is one shingle of them all."""
    counts = np.diff(per)
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_per = np.concatenate([[0], np.cumsum(many)])
    factors = mix(np.arange(11, 11 + size, dtype=_U)) | _U(1)
    out = np.empty(out_per[-1], _U)
    if len(hashes) >= size:
        rolled = hashes[: len(hashes) - size + 1] * factors[0]
        for j in range(1, size):
            rolled = rolled + hashes[j : len(hashes) - size + 1 + j] * factors[j]
        long = np.flatnonzero(counts >= size)
        if len(long):
            first = np.repeat(per[:-1][long] - out_per[:-1][long], many[long])
            spots = np.arange(out_per[-1])[np.repeat(counts >= size, many)]
            out[spots] = mix(rolled[spots + first])
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        got = hashes[per[d] : per[d + 1]]
        with np.errstate(over="ignore"):
            out[out_per[d]] = mix(np.array([(got * factors[: len(got)]).sum(dtype=_U) + _U(len(got))]))[0]
    return out, out_per


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, per: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(values, kind))
