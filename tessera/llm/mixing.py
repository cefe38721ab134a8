"""Mixing sources to target weights.

Each source's words form one stream, cut into blocks of `block` words. A source's share of the mix is a number of
slots over its blocks; a multinomial draw deals its slots to the output shards, and slot j reads block
perm(j mod blocks) of pass j div blocks, where perm is a keyed pseudorandom permutation of the source's block
indices (a Feistel network with cycle walking, a new key for each pass). Slots and blocks meet in an equi-join on
(source, block index), so a hot source spreads over its blocks.

Departure: the draw per shard and source is a multinomial one conditioned on each source's total (each source's slots are dealt to
the shards), so a source's taken words equal its rounded target, while shards differ in size; the last slot of the last
pass may read only the head of its block. No block is read more than `cap` times.

Defined cases: a null text has size 0 and nothing taken; a null source is a source of its own, last in order; an
empty table gives an empty mix; repeated rows are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK, SHARDS, CAP, BUCKET_ROWS, SEED = 256, 64, 3, 4096, 20_240_229
#: Column that tells rows apart, if the caller has one.
ROW = "_tessera_row"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null: null and every string are keys of their own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sizes: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """sizes (g, source, source_size) -> with weight and target: shares of the whole, none above cap times its size."""
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = C.written(sizes.withColumn("weight", F.element_at(F.lit(weights), (rank % n + 1).cast("int")).cast("double")))
    whole = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("source_size") * float(cap) < F.col("weight") * level
        held, active = weighted.agg(F.sum(F.when(capped, F.col("source_size") * float(cap)).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        new = (whole - held) / active if active else level
        if not active or new <= level:
            break
        level = new
    return weighted.withColumn("target", F.least(F.col("source_size") * float(cap), F.col("weight") * level))


def _feistel(x: np.ndarray, bits: int, key: int) -> np.ndarray:
    half = bits // 2
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(4):
        left, right = right, left ^ (C.mix(right + np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) & mask)
    return (left << np.uint64(half)) | right


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of x under a keyed permutation of range(n)."""
    bits = max(2, (n - 1).bit_length())
    bits += bits % 2
    out = _feistel(x.astype(np.uint64), bits, key)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = _feistel(out[far], bits, key)
    return out.astype(np.int64)


def _key(name: str, seed: int, epoch: int) -> int:
    start = int.from_bytes(__import__("hashlib").blake2b(f"{seed}|{name}".encode(), digest_size=8).digest(), "little")
    return (start + epoch * 0xD1B54A32D192ED03) % (1 << 64)


def _plan(block: int, shards: int, seed: int):
    """Per source: how many slots the mix has, and the multinomial draw that deals them to the shards."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                size, take = r["source_size"], r["take"]
                if not size or not take:
                    continue
                blocks = -(-size // block)
                passes, rest = divmod(take, size)
                slots, part = passes * blocks, 0
                if rest:
                    tail, key = size - (blocks - 1) * block, _key(r["g"], seed, passes)
                    at = _position(blocks - 1, blocks, key)
                    if rest > at * block + tail:
                        more = rest - at * block - tail
                        n, part = at + 1 + -(-more // block), (more - 1) % block + 1
                    elif rest > at * block:
                        n, part = at + 1, rest - at * block
                    else:
                        n, part = -(-rest // block), (rest - 1) % block + 1
                    slots += n
                draw = np.random.default_rng(_key(r["g"], seed, 1 << 20)).multinomial(slots, [1 / shards] * shards)
                first = 0
                for shard, n in enumerate(draw.tolist()):
                    if n:
                        rows.append((r["g"], shard, first, n, slots, part, blocks))
                    first += n
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate([pa.string(), *[pa.int64()] * 6])], ["g", "shard", "first", "n", "slots", "part", "blocks"])

    return run


def _position(x: int, n: int, key: int) -> int:
    """Where the permutation puts x: the inverse network, walked back."""
    bits = max(2, (n - 1).bit_length())
    bits += bits % 2
    half = bits // 2
    mask = np.uint64((1 << half) - 1)
    y = np.array([x], np.uint64)
    while True:
        left, right = y >> np.uint64(half), y & mask
        for r in reversed(range(4)):
            left, right = right ^ (C.mix(left + np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) & mask), left
        y = (left << np.uint64(half)) | right
        if y[0] < n:
            return int(y[0])


def _slots(seed: int):
    """(g, shard, first, n, ...) -> (g, block, whole, part): the block that each slot reads."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                j = np.arange(r["first"], r["first"] + r["n"], dtype=np.int64)
                epoch, spot = j // r["blocks"], j % r["blocks"]
                read = np.empty(len(j), np.int64)
                for e in np.unique(epoch):
                    read[epoch == e] = permuted(spot[epoch == e], r["blocks"], _key(r["g"], seed, int(e)))
                cut = (j == r["slots"] - 1) & (r["part"] > 0)
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(j), pa.string()), pa.array(np.full(len(j), r["shard"])), pa.array(read), pa.array((~cut).astype(np.int64)), pa.array(np.where(cut, r["part"], 0))], ["g", "shard", "block", "whole", "part"])

    return run


def mix(docs: DataFrame, weights: list[int] | None = None, cap: int = CAP, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (placed, pieces, slots).

    placed: doc_id, source, g, size, start (first word's index in the source's stream), source_size, target.
    pieces: doc_id, g, size, start, block, lo, hi (the document's words in the block), whole, part (full reads, words of the cut read).
    slots: g, shard, block, whole, part: the mix itself, shard by shard.
    """
    own = [c for c in (ROW,) if c in docs.columns]
    sized = C.written(docs.select(*own, "doc_id", "source", source_key(F.col("source")).alias("g"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")))
    # Documents of a source are put in order inside buckets, as many as it takes for about BUCKET_ROWS of the largest.
    buckets = -(-(sized.groupBy("g").count().agg(F.max("count")).first()[0] or 1) // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    sums = C.written(sized.groupBy("g", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("g", "bucket", before.alias("base"))
    local = F.coalesce(F.sum("size").over(Window.partitionBy("g", "bucket").orderBy("doc_id", "size", "mark", *own).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aim = C.written(targets(sums.groupBy("g").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights or [1, 2, 3], cap).select("g", "source_size", "target"))
    placed = sized.withColumn("local", local).join(bases, ["g", "bucket"]).select(*own, "doc_id", "source", "g", "size", (F.col("base") + F.col("local")).alias("start"))
    placed = C.written(C.join_checked(placed, aim, ["g"], "inner"))
    plan = aim.withColumn("take", F.least(F.round("target").cast("long"), F.col("source_size") * cap)).mapInArrow(_plan(block, shards, seed), "g string, shard long, first long, n long, slots long, part long, blocks long")
    step = 1 << 16
    parts = plan.withColumn("skip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long")))).select("g", "shard", (F.col("first") + F.col("skip")).alias("first"), F.least(F.lit(step).cast("long"), F.col("n") - F.col("skip")).alias("n"), "slots", "part", "blocks")
    # A stated number of partitions: the rows are few and small but make many slots, which adaptive execution doesn't see.
    slots = parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "first").mapInArrow(_slots(seed), "g string, shard long, block long, whole long, part long")
    reads = slots.groupBy("g", "block").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"))
    last = (F.col("start") + F.col("size") - 1) / block
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last)))).withColumn("lo", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    pieces = pieces.join(reads.hint("merge"), ["g", "block"], "left").withColumns({"whole": F.coalesce("whole", F.lit(0)), "part": F.coalesce("part", F.lit(0))})
    return placed, pieces, slots


def mixed(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    placed, pieces, _ = mix(docs, **options)
    from_piece = F.col("whole") * (F.col("hi") - F.col("lo")) + F.greatest(F.least(F.col("hi"), F.col("part")) - F.col("lo"), F.lit(0))
    taken = pieces.groupBy("g", "start", "doc_id", "source", "size", "source_size", "target").agg(F.sum(from_piece).alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return taken.select(*columns).unionByName(placed.where("size = 0").withColumn("taken", F.lit(0)).select(*columns))


def _render(batches):
    """Rows with text and segments (lo, hi, times): one text for each pass that reads some of the document's words."""
    for batch in batches:
        keep, texts = [], []
        for i, (text, segments) in enumerate(zip(batch.column("text").to_pylist(), batch.column("segments").to_pylist())):
            starts, ends, _, _ = C.words(data := np.frombuffer((raw := (text or "").encode()), np.uint8), np.array([0, len(raw)]), hashes=False) if text else ([], [], None, None)
            for lap in range(max((s["times"] for s in segments), default=0)):
                runs: list[list[int]] = []
                for s in sorted((s for s in segments if s["times"] > lap), key=lambda s: s["lo"]):
                    if runs and runs[-1][1] == s["lo"]:
                        runs[-1][1] = s["hi"]
                    else:
                        runs.append([s["lo"], s["hi"]])
                keep.append(i)
                whole = len(runs) == 1 and runs[0] == [0, len(starts)]
                texts.append(text if whole else "\n".join(raw[starts[a] : ends[b - 1]].decode() for a, b in runs))
        out = pa.Table.from_batches([batch]).drop_columns(["text", "segments"]).take(pa.array(keep, pa.int64()))
        out = out.append_column("text", pa.array(texts, pa.string()))
        yield from out.combine_chunks().to_batches()


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a document is returned once for each pass that reads words of it, with just those words.

    Columns as the input's. A document of which no word is taken goes. Rows are told apart by a number of their own, so null and
    repeated ids are documents like others.
    """
    base = C.written(docs.select("doc_id", "text", "lang", "source").withColumn(ROW, F.monotonically_increasing_id()))
    _, pieces, _ = mix(base, **options)
    at = F.col("block") * options.get("block", BLOCK) - F.col("start")
    segment = lambda hi, times: F.struct((F.col("lo") + at).alias("lo"), (hi + at).alias("hi"), times.cast("long").alias("times"))
    cut = F.least(F.col("hi"), F.col("part"))
    parts = pieces.select(ROW, F.when(cut > F.col("lo"), F.when(cut < F.col("hi"), F.array(segment(cut, F.col("whole") + 1), F.struct((cut + at).alias("lo"), (F.col("hi") + at).alias("hi"), F.col("whole").cast("long").alias("times")))).otherwise(F.array(segment(F.col("hi"), F.col("whole") + 1)))).otherwise(F.array(segment(F.col("hi"), F.col("whole")))).alias("s"))
    parts = C.written(parts.groupBy(ROW).agg(F.filter(F.flatten(F.collect_list("s")), lambda x: x["times"] > 0).alias("segments")).where("size(segments) > 0"))
    joined = base.join(parts.hint("merge"), ROW).select("doc_id", "lang", "source", "text", "segments")
    out = joined.mapInArrow(C.trimmed(_render), "doc_id long, lang string, source string, text string")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
