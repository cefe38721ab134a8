"""Embedding near-dedup by collision-counting projections.

A line is one-dimensional: vectors are sorted by the value of a random projection, within the region that the signs of
K further projections give, K = round(log2 n). A query's window on a line reaches WINDOW deviations of a linking
pair's difference to both sides; vectors in it collide with the query. Collisions are counted per pair over all lines,
and pairs of COLLISIONS or more are verified by cosine in double precision. The number of lines is the least that lets a
pair at the threshold reach that count with probability RECALL, by the binomial distribution of its collisions.

Dense groups are drawn together first, so that no group's pairs are all listed: on HUB_LINES lines, every vector
meets the smallest vec_id of its region, and joins it as a ball's centre if their angle is at most half the linking
angle; members of a ball all link with each other. On the lines, a ball's members of one region are one interval from the
least to the greatest of their values, so every member takes part: balls collide where members would, and colliding balls
are verified by their centres' angle with the slack of their radii. Links are then counted exactly across each pair of balls that touch,
in blocks of about BLOCK vectors by BLOCK; they yield counts and one edge per vector, not pairs. Equal vectors
are one from the start, with their number as weight.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; null ids and repeated ids: rows of a null id link with nothing, rows that repeat an id
count as one vector (any of them); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COSINE, COLLISIONS, RECALL, WINDOW, HUB_LINES, BLOCK, SEED = 0.9, 2, 0.998, 2.5, 12, 384, 11


def lines_needed(n: int, cosine: float = COSINE, collisions: int = COLLISIONS, recall: float = RECALL) -> tuple[int, int]:
    """(lines, sign bits per line)."""
    bits = min(max(round(math.log2(max(n, 2))), 6), 40)
    p = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(WINDOW / math.sqrt(2))
    m = collisions
    while sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(collisions)) > 1 - recall:
        m += 1
    return m, bits


_directions: dict[tuple, np.ndarray] = {}


def _matrix(dim: int, lines: int, bits: int, seed: int) -> np.ndarray:
    key = (dim, lines, bits, seed)
    if key not in _directions:
        _directions.clear()
        _directions[key] = np.random.default_rng([seed, dim]).standard_normal((dim, lines * (bits + 1)))
    return _directions[key]


def _units(batches):
    """vec_id, embedding -> vec_id, unit vector as bytes of doubles (null if it links with nothing)."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, np.float64)
            if x is not None:
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None
            out.append(None if x is None or not np.isfinite(x).all() else (x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "unit"])


def _lines(lines: int, bits: int, only: int, seed: int):
    """vec_id, unit -> vec_id and, for the first `only` lines, (line, region, value); the region tells dimensions apart too."""

    def run(batches):
        weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.float64)
        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            units = batch.column("unit").to_pylist()
            sizes = np.array([len(u) // 8 for u in units])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for part in np.array_split(rows, -(-len(rows) // 512)):
                    x = np.frombuffer(b"".join(units[i] for i in part), np.float64).reshape(len(part), dim)
                    y = (x @ _matrix(int(dim), lines, bits, seed)[:, : only * (bits + 1)]).reshape(len(part), only, bits + 1)
                    region = ((y[:, :, 1:] > 0) @ weights).astype(np.int64) * 4096 + int(dim) % 4096
                    line = np.tile(np.arange(only, dtype=np.int64), len(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], only)), pa.array(line), pa.array(region.ravel()), pa.array(y[:, :, 0].ravel().copy())], ["vec_id", "line", "region", "value"])

    return run


_LINES = "vec_id long, line long, region long, value double"


def _collisions(reach: float):
    """Rows sorted by (line, region, value): pairs on one line and region whose intervals (value to high, if there is one) are at most `reach` apart."""

    def pairs(line, region, value, ids, high, fresh):
        """Pairs whose later member is at index `fresh` or after."""
        n, step, out = len(ids), 1, []
        longest = (high - value).max()
        while step < n:
            a, b = np.arange(n - step), np.arange(step, n)
            same = (line[a] == line[b]) & (region[a] == region[b])
            if not (same & (value[b] - value[a] <= reach + longest)).any():
                break
            hit = same & (value[b] - high[a] <= reach) & (b >= fresh)
            out.append((np.minimum(ids[a[hit]], ids[b[hit]]), np.maximum(ids[a[hit]], ids[b[hit]])))
            step += 1
        return out

    def run(batches):
        held = None
        for batch in batches:
            new = [np.asarray(batch.column(c)) for c in ("line", "region", "value", "vec_id")]
            new.append(np.asarray(batch.column("high")) if "high" in batch.schema.names else new[2])
            if not len(new[0]):
                continue
            fresh = 0 if held is None else len(held[0])
            both = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            for a, b in pairs(*both, fresh):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            tail = (both[0] == both[0][-1]) & (both[1] == both[1][-1]) & (both[4] >= both[2][-1] - reach)
            held = [x[tail] for x in both]

    return run


def _cosines(batches):
    for batch in batches:
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        cos = [float(np.dot(np.frombuffer(p), np.frombuffer(q))) if len(p) == len(q) else -2.0 for p, q in zip(x, y)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(cos, pa.float64())], ["a", "b", "cosine"])


def _cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    both = pairs.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(C.trimmed(_cosines), "a long, b long, cosine double")


def _count(cosine: float):
    """Rows of two blocks (a, ids, weights, units and b, ids_b, ...) -> (vec_id, n, root): links across by weight, and the other ball's centre."""

    def run(batches):
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in range(batch.num_rows):
                (p, w, x), (q, v, y) = ((np.array(batch.column(f"ids{k}")[i].as_py(), np.int64), np.array(batch.column(f"weights{k}")[i].as_py(), np.int64), batch.column(f"units{k}")[i].values.to_pylist()) for k in ("", "_b"))
                x, y = (np.frombuffer(b"".join(u), np.float64).reshape(len(u), -1) for u in (x, y))
                links = x @ y.T >= cosine
                for ids, n, root in ((p, links @ v, batch.column("b")[i].as_py()), (q, w @ links, batch.column("a")[i].as_py())):
                    good = n > 0
                    out.append((ids[good], n[good], np.full(good.sum(), root)))
            columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["vec_id", "n", "root"])

    return run


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, collisions: int = COLLISIONS, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = C.written(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(C.trimmed(_units), "vec_id long, unit binary"))
    known = C.written(rows.where("unit is not null and vec_id is not null").groupBy("vec_id").agg(F.min("unit").alias("unit")))
    valid = C.written(known.groupBy("unit").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")))
    copied = C.written(valid.where("weight > 1").select("unit", F.col("vec_id").alias("rep")))
    same = C.written(C.join_checked(known, copied, ["unit"], "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep")))
    n = valid.count()
    lines, bits = lines_needed(n, cosine, collisions, recall)
    half = math.acos(cosine) / 2
    hub_lines = min(HUB_LINES, lines)
    units = valid.select("vec_id", "unit")

    drawn = C.written(units.mapInArrow(C.trimmed(_lines(lines, bits, hub_lines, seed)), _LINES).select("vec_id", "line", "region"))
    hubs = C.written(drawn.groupBy("line", "region").agg(F.min("vec_id").alias("b"), F.max("vec_id").alias("last")).where("b <> last").drop("last"))
    meets = C.join_checked(drawn, hubs, ["line", "region"], "inner").where("vec_id <> b").select(F.col("vec_id").alias("a"), "b").distinct()
    close = C.written(_cosine(meets, units).where(F.col("cosine") >= math.cos(half)))
    centres = units.select("vec_id").join(close.select(F.col("a").alias("vec_id")).distinct(), "vec_id", "left_anti")
    ball = close.join(centres.withColumnRenamed("vec_id", "b"), "b").groupBy("a").agg(F.min_by(F.struct("b", "cosine"), "b").alias("c"))
    ball = C.written(ball.select(F.col("a").alias("vec_id"), F.col("c.b").alias("centre"), F.acos(F.least(F.col("c.cosine"), F.lit(1.0))).alias("angle")))
    member = C.written(valid.join(ball, "vec_id", "left").select("vec_id", F.coalesce("centre", "vec_id").alias("centre"), F.coalesce("angle", F.lit(0.0)).alias("angle"), "unit", "weight"))
    radius = C.written(member.groupBy("centre").agg(F.max("angle").alias("radius"), F.count("*").alias("held"), F.sum("weight").alias("mass")))

    parts = member.select(F.col("centre").alias("vec_id"), "unit").mapInArrow(C.trimmed(_lines(lines, bits, lines, seed)), _LINES)
    balls = parts.groupBy("line", "region", "vec_id").agg(F.min("value").alias("value"), F.max("value").alias("high"))
    reach = WINDOW * math.sqrt(2 - 2 * cosine)
    spread = balls.repartition("line", "region").sortWithinPartitions("line", "region", "value", "vec_id")
    counted = C.written(spread.mapInArrow(C.trimmed(_collisions(reach)), "a long, b long").groupBy("a", "b").count().where(F.col("count") >= collisions).select("a", "b"))
    of = lambda k: radius.select(F.col("centre").alias(k), F.col("radius").alias(f"r{k}"), F.ceil(F.col("held") / BLOCK).alias(f"n{k}"))
    near = _cosine(counted, units).join(of("a"), "a").join(of("b"), "b")
    touching = near.where(F.acos(F.least(F.greatest("cosine", F.lit(-1.0)), F.lit(1.0))) <= math.acos(cosine) + F.col("ra") + F.col("rb") + 1e-9)
    # Members of a ball all link. Across balls that touch, each block of the one meets each of the other.
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{k}") - 1))
    pairs = C.written(touching.withColumn("i", each("a")).withColumn("j", each("b")).select("a", "i", "b", "j"))
    sized = C.join_checked(member, radius.select("centre", "held"), ["centre"], "inner").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("held") / BLOCK)))
    r = F.collect_list(F.struct("vec_id", "weight", "unit"))
    blocks = C.written(sized.groupBy("centre", "block").agg(r.alias("r")).select("centre", "block", F.col("r.vec_id").alias("ids"), F.col("r.weight").alias("weights"), F.col("r.unit").alias("units")))
    second = blocks.toDF("b", "j", "ids_b", "weights_b", "units_b")
    met = pairs.join(blocks.withColumnsRenamed({"centre": "a", "block": "i"}), ["a", "i"]).join(second, ["b", "j"])
    across = met.select("a", "b", "ids", "weights", "units", "ids_b", "weights_b", "units_b").mapInArrow(C.trimmed(_count(cosine)), "vec_id long, n long, root long")
    inside = member.join(radius.select("centre", "mass"), "centre").select("vec_id", (F.col("mass") - F.col("weight")).alias("n"), F.col("centre").alias("root"))
    found = C.written(across.unionByName(inside))
    totals = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    linked = C.components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).toDF("vec_id", "component")
    classes = valid.select("vec_id", "weight").join(totals, "vec_id", "left").join(linked, "vec_id", "left")
    classes = C.written(classes.select(F.col("vec_id").alias("rep"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    out = rows.select("vec_id").join(same, "vec_id", "left").join(classes, "rep", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
