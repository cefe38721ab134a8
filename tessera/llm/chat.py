"""Cumulative-snapshot collapse of logged conversations, then rendering.

A conversation logged again after each turn leaves snapshots that prefix a longer log. Every turn gets a hash of its
position, role and text; a prefix's hash is the sum of its turns' hashes (two sums of 40-bit parts, so they never
overflow). Grouped by (prefix length, prefix hash), a conversation is maximal if no longer one has its whole hash as
a prefix; of equal conversations the smallest conv_id stays. That grouped maximum stands in place of an anti-join, which gives the
same rows with one shuffle more. Only maximal conversations are rendered.

Turns are ordered by (turn, role, text), nulls first. Positions and prefix sums are taken in two levels, within
ranges of RANGE turns and over the ranges, so one endless conversation doesn't sort in one task. Defined cases: null
role or text renders as empty and equals only null; rows with a null conv_id belong to no conversation and go;
repeated turns count each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RANGE = 256


def prefixes(turns: DataFrame, span: int = RANGE) -> DataFrame:
    """(conv_id, pos, role, text, h1, h2): turns in order with the hashes of the prefixes that they end."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / span))
    sizes = rows.groupBy("conv_id", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.select("conv_id", "part", before.alias("base")), ["conv_id", "part"])
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    placed = placed.withColumn("pos", F.col("base") + F.row_number().over(inside))
    parts = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text"), 24) for seed in (1, 2)]
    placed = placed.withColumns({"t1": parts[0], "t2": parts[1]})
    running = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("conv_id", "part").agg(F.sum("t1").alias("s1"), F.sum("t2").alias("s2"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("conv_id", "part", *[F.coalesce(F.sum(f"s{i}").over(over), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    placed = placed.join(bases, ["conv_id", "part"])
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "text", *[(F.col(f"b{i}") + F.sum(f"t{i}").over(running)).alias(f"h{i}") for i in (1, 2)])


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): the maximal conversations; n_equal logs are the same as it, itself included."""
    keys = C.written(prefixes(turns).select("conv_id", "pos", "h1", "h2"))
    lengths = keys.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    sized = keys.join(lengths, "conv_id")
    whole = F.col("pos") == F.col("n_turns")
    groups = sized.groupBy("pos", "h1", "h2").agg(F.max("n_turns").alias("longest"), F.min(F.when(whole, F.col("conv_id"))).alias("conv_id"), F.count(F.when(whole, 1)).alias("n_equal"))
    return groups.where("longest = pos").select("conv_id", F.col("pos").alias("n_turns"), "n_equal")


def render(turns: DataFrame) -> DataFrame:
    """Maximal conversations as text: <|role|>, a newline, the turn's text and a newline for every turn, then <|end|>."""
    kept = C.written(collapse(turns))
    own = C.join_checked(turns.where("conv_id is not null").select("conv_id", "turn", "role", "text"), kept.select("conv_id"), ["conv_id"], "left_semi")
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    # Nulls sort first in structs, as in prefixes().
    body = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", piece.alias("piece")))).alias("p"))
    body = body.select("conv_id", F.concat(F.concat_ws("", F.transform("p", lambda x: x["piece"])), F.lit("<|end|>")).alias("rendered"))
    return kept.join(body, "conv_id").select("conv_id", "n_turns", "n_equal", "rendered")
