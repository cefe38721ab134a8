"""Hard-negative mining with a vector-approximation file.

Components are integers, floor(256 * x). Each dimension is cut into CELLS cells at normal quantiles of its mean and deviation over all rows;
every row is in the file as one byte a dimension, its cell. For an anchor, a table gives each dimension's least and greatest product
with the values of each cell; a row's lower and upper score bounds are sums of table entries at its cells. Two scans of the file
leave candidates, and only those are scored exactly:

1. Positives: rows of the anchor's label whose upper bound reaches the POSITIVES-th greatest lower bound.
2. Negatives: for the window that each positive's score gives, rows of other labels whose bounds meet the window and whose upper
   bound reaches the NEGATIVES-th greatest lower bound among rows that are surely inside. Rows below it can't enter the window's list.

A scan deals rows into slices and anchors into blocks of bounded size; each slice meets each block in one group. Thresholds are
first taken inside a group, then over all slices of an anchor. Of rows with equal vector and label only the smallest ids can ever be
listed, so the file holds as many of them as a list is long (and one more, for the anchor itself): equal rows beyond are dominated, and
thousands of copies don't become thousands of candidates.

Defined cases: rows with a null id, label or vector, an empty vector, a null or non-finite component, or a component of 2^17 or more
(scores would overflow) take no part; rows that repeat an id count as one, the one with the least (label, vector bytes); a product of
different lengths isn't defined, so rows of another length than most rows have take no part; anchors without positives or
without rows in the window give no rows; an empty table gives none; further columns are not read.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

POSITIVES, NEGATIVES, LOW, HIGH, CELLS = 5, 10, 30, 90, 64
#: Rows of a slice and anchors of a block; a group holds one of each.
SLICE_ROWS, BLOCK_ANCHORS = 65_536, 16_384
#: A slice is smaller while there are fewer slices than cores, down to so many rows.
LEAST_SLICE = 2_048
_LIMIT = 1 << 25
_MIN = np.iinfo(np.int64).min


def _integers(batches):
    """vec_id, label, embedding -> the rows that take part, with their integer components as little-endian int32."""
    for batch in batches:
        column = batch.column("embedding").cast(pa.large_list(pa.float64()))
        n = batch.num_rows
        offs = np.asarray(column.offsets)[: n + 1]
        flat = column.values.slice(offs[0], offs[-1] - offs[0])
        offs = offs - offs[0]
        x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(x * 256.0)
        bad = np.append(0, np.cumsum(~(np.abs(x) < _LIMIT)))
        valid = [c.is_valid().to_numpy(zero_copy_only=False) for c in (batch.column("vec_id"), batch.column("label"), column)]
        keep = np.logical_and.reduce(valid) & (bad[offs[1:]] == bad[offs[:-1]]) & (np.diff(offs) > 0)
        whole = np.where(np.abs(x) < _LIMIT, x, 0).astype("<i4")
        rows = np.flatnonzero(keep)
        made = pa.array([whole[offs[i] : offs[i + 1]].tobytes() for i in rows], pa.binary())
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), made], ["vec_id", "label", "x"])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _moments(dim: int):
    """x -> (j, n, total, squares, least, greatest) of a task's rows."""

    def run(batches):
        n, total, squares = 0, np.zeros(dim), np.zeros(dim)
        least, greatest = np.full(dim, _LIMIT, np.int64), np.full(dim, -_LIMIT, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), dim)
                n, total, squares = n + len(x), total + x.sum(0, dtype=np.float64), squares + (x.astype(np.float64) ** 2).sum(0)
                least, greatest = np.minimum(least, x.min(0)), np.maximum(greatest, x.max(0))
        if n:
            columns = [np.arange(dim), np.full(dim, n), total, squares, least, greatest]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["j", "n", "total", "squares", "least", "greatest"])

    return run


def cells(rows: DataFrame, dim: int, count: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each dimension: the cells' first values but the first cell's, and each cell's least and greatest value. From sums over all rows."""
    parts = rows.select("x").mapInArrow(_moments(dim), "j long, n long, total double, squares double, least long, greatest long")
    sums = parts.groupBy("j").agg(F.sum("n"), F.sum("total"), F.sum("squares"), F.min("least"), F.max("greatest")).orderBy("j").collect()
    _, n, total, squares, least, greatest = (np.array(c, np.float64) for c in zip(*sums))
    spread = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0))
    steps = np.array([NormalDist().inv_cdf(k / count) for k in range(1, count)])
    edges = np.ceil(total[:, None] / n[:, None] + spread[:, None] * steps).astype(np.int64)
    low = np.concatenate([least[:, None].astype(np.int64), edges], 1)
    high = np.concatenate([edges - 1, greatest[:, None].astype(np.int64)], 1)
    # A cell outside the values that occur is empty; no row looks it up.
    return edges, np.clip(low, least[:, None], greatest[:, None]).astype(np.int64), np.clip(high, least[:, None], greatest[:, None]).astype(np.int64)


def _encode(edges: np.ndarray, dim: int):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            codes = np.empty(x.shape, np.uint8)
            for j in range(dim):
                codes[:, j] = np.searchsorted(edges[j], x[:, j], "right")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "label", "codes"])

    return run


class _Bounds:
    """Lower and upper score bounds of anchors against a slice's rows, by table lookup."""

    def __init__(self, codes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.codes, self.low, self.high = np.ascontiguousarray(codes.T).astype(np.intp), low, high
        self.most = np.maximum(np.abs(low), np.abs(high)).max(1)

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = np.int32 if (np.abs(q).astype(np.int64) * self.most).sum(1).max() < 2**31 - 1 else np.int64
        a, b = q[:, :, None].astype(np.int64) * self.low, q[:, :, None].astype(np.int64) * self.high
        least, most = np.minimum(a, b).astype(kind), np.maximum(a, b).astype(kind)
        out = np.zeros((2, len(q), self.codes.shape[1]), kind)
        for j, code in enumerate(self.codes):
            out[0] += least[:, j].take(code, axis=1)
            out[1] += most[:, j].take(code, axis=1)
        return out[0], out[1]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; the least value if there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), np.iinfo(values.dtype).min, values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


_FOUND = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("mask", pa.int64()), ("sure", pa.int64())])
_FOUND_DDL = "anchor_id long, vec_id long, low long, high long, mask long, sure long"


def _scan(low: np.ndarray, high: np.ndarray, dim: int, k: int, windows: bool):
    """A slice of the file and a block of anchors -> candidates. Without windows: of the anchor's label; else of others, with bit masks of the windows
    that they may be in and those that they are surely in."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _FOUND.empty_table()
        bounds = _Bounds(_matrix(rows.column("codes"), dim, "u1"), low, high)
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        q, own, kind = _matrix(anchors.column("x"), dim), anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        spans = anchors.column("spans").to_pylist() if windows else []
        step, out = max(1, (1 << 19) // len(ids)), []
        for at in range(0, len(q), step):
            a = slice(at, at + step)
            least, most = bounds.of(q[a])
            lowest = np.iinfo(least.dtype).min
            if windows:
                other = labels[None, :] != kind[a, None]
                mask, sure = (np.zeros(least.shape, np.int64) for _ in range(2))
                for w in range(max(map(len, spans[a]))):
                    span = np.array([s[w] if w < len(s) else (1, 0) for s in spans[a]], np.int64)
                    span = np.clip(span, lowest, np.iinfo(least.dtype).max).astype(least.dtype)
                    lo, hi = span[:, :1], span[:, 1:]
                    inside = other & (least >= lo) & (most <= hi) & (lo <= hi)
                    bar = _kth(np.where(inside, least, lowest), k)[:, None]
                    may = other & (least <= hi) & (most >= lo) & (most >= bar) & (lo <= hi)
                    mask |= may.astype(np.int64) << w
                    sure |= (inside & may).astype(np.int64) << w
            else:
                same = (labels[None, :] == kind[a, None]) & (ids[None, :] != own[a, None])
                mask = sure = (same & (most >= _kth(np.where(same, least, lowest), k)[:, None])).astype(np.int64)
            i, j = np.nonzero(mask)
            out.append(pa.table([pa.array(c.astype(np.int64)) for c in (own[a][i], ids[j], least[i, j], most[i, j], mask[i, j], sure[i, j])], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _dot(dim: int):
    def run(batches):
        for batch in batches:
            x, q = _matrix(batch.column("x"), dim), _matrix(batch.column("q"), dim)
            score = np.einsum("ij,ij->i", x.astype(np.int64), q.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("anchor_id", "vec_id", "mask")] + [pa.array(score)], ["anchor_id", "vec_id", "mask", "score"])

    return run


class _File:
    """The approximation file with its rows, and the scans over it."""

    def __init__(self, rows: DataFrame, dim: int, copies: int):
        self.dim, self.rows = dim, rows
        edges, self.low, self.high = cells(rows, dim)
        first = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
        held = rows.withColumn("_copy", first).where(F.col("_copy") <= copies).drop("_copy")
        self.file = C.written(held.mapInArrow(C.trimmed(_encode(edges, dim)), "vec_id long, label long, codes binary"))
        self.n = self.file.count()

    def scan(self, anchors: DataFrame, k: int, windows: int = 0) -> DataFrame:
        """Candidates (anchor_id, vec_id, mask) after thresholds over all slices. anchors: vec_id, label, x and, with so many windows, spans."""
        cores = self.file.sparkSession.sparkContext.defaultParallelism
        slices = max(-(-self.n // SLICE_ROWS), min(-(-self.n // LEAST_SLICE), 2 * cores), 1)
        blocks = max(-(-anchors.count() // BLOCK_ANCHORS), 1)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
        rows = self.file.withColumn("slice", dealt(slices, 1)).withColumn("block", each(blocks))
        asked = anchors.withColumn("block", dealt(blocks, 2)).withColumn("slice", each(slices))
        last = windows - 1
        met = rows.groupBy("slice", "block").cogroup(asked.groupBy("slice", "block"))
        found = C.written(met.applyInArrow(_scan(self.low, self.high, self.dim, k, windows > 0), _FOUND_DDL))
        bits = F.expr(f"filter(sequence(0, {last}), w -> (sure >> w) & 1 = 1)") if windows else F.array(F.lit(0))
        each_sure = found.where("sure <> 0").select("anchor_id", "low", F.explode(bits).alias("w"))
        ranked = each_sure.withColumn("r", F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("low")))).where(F.col("r") <= k)
        bars = ranked.where(F.col("r") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "low"))).alias("bars"))
        bars = C.written(bars.select("anchor_id", "bars"))
        mask = F.expr(f"aggregate(sequence(0, {last}), 0L, (m, w) -> m | if((mask >> w) & 1 = 1 and high >= coalesce(bars[w], {_MIN + 1}L), shiftleft(1L, w), 0L))") if windows else F.when(F.col("high") >= F.coalesce(F.col("bars")[0], F.lit(_MIN + 1)), F.lit(1)).otherwise(F.lit(0)).cast("long")
        return found.join(bars, "anchor_id", "left").select("anchor_id", "vec_id", mask.alias("mask")).where("mask <> 0")

    def scored(self, candidates: DataFrame, anchors: DataFrame) -> DataFrame:
        """(anchor_id, vec_id, mask, score): exact products."""
        both = candidates.join(self.rows.select("vec_id", "x"), "vec_id").join(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("x").alias("q")), "anchor_id")
        return both.select("anchor_id", "vec_id", "mask", "x", "q").mapInArrow(C.trimmed(_dot(self.dim)), "anchor_id long, vec_id long, mask long, score long")


def mined(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows of `vectors` (vec_id, label, embedding) for which `anchors` holds.

    For each anchor and each of its first `positives` rows of the same label: the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Greater scores come first, ties by smaller vec_id.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    if not 1 <= positives <= 62 or negatives < 1 or not 0 <= low <= high:
        raise ValueError("1 to 62 positives, at least one negative and 0 <= low <= high")
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").mapInArrow(C.trimmed(_integers), "vec_id long, label long, x binary")
    rows = C.written(kept.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.*"))
    sizes = rows.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if sizes is None:
        return spark.createDataFrame([], empty)
    same = rows.where(F.octet_length("x") == sizes["bytes"])
    file = _File(same, sizes["bytes"] // 4, max(positives + 1, negatives))
    asked = C.written(same.where(anchors))
    best = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    near = file.scored(file.scan(asked, positives), asked).withColumn("w", best - 1).where(F.col("w") < positives)
    near = near.select("anchor_id", "w", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The least and the greatest whole score inside; none for a negative score.
    s, whole, rest = (F.col("positive_score"), F.expr("positive_score div 100"), F.col("positive_score") % 100)
    bound = lambda share, up: whole * share + F.floor((rest * share + up) / 100)
    near = C.written(near.withColumns({"a": F.when(s < 0, 1).otherwise(bound(low, 99)).cast("long"), "b": F.when(s < 0, 0).otherwise(bound(high, 0)).cast("long")}))
    spans = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("w", F.array("a", "b").alias("s")))).alias("p")).select(F.col("anchor_id").alias("vec_id"), F.col("p.s").alias("spans"))
    windowed = C.written(asked.join(spans, "vec_id"))
    hits = file.scored(file.scan(windowed, negatives, positives), windowed)
    inside = hits.withColumn("w", F.explode(F.expr("filter(sequence(0, 61), w -> (mask >> w) & 1 = 1)"))).join(near, ["anchor_id", "w"])
    inside = inside.where(F.col("score").between(F.col("a"), F.col("b")))
    order = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
    out = inside.withColumn("rank", order).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
