"""Conversation threads: reply edges, roots and paths, and the text of a thread that fits a length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import written


def edges(posts: DataFrame, conversation: str, key: str, parent: str) -> DataFrame:
    """(conversation, child, parent) for replies whose parent is in the same conversation."""
    child = posts.select(F.col(conversation).alias("conversation"), F.col(key).alias("child"), F.col(parent).alias("parent")).where("parent is not null")
    have = posts.select(F.col(conversation).alias("conversation"), F.col(key).alias("parent")).distinct()
    return child.join(have, ["conversation", "parent"], "left_semi").select("conversation", "child", "parent")


def paths(posts: DataFrame, conversation: str, key: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """(conversation, key, root, depth, path): ancestors from the root down. Replies to absent posts are roots.

    Rounds of pointer doubling over written tables: each joins the half-known paths with themselves, so depth d takes
    log2 d joins. On a cycle, the path ends before the first ancestor that it would hold twice.
    Paths longer than max_depth, if it is given, are left as they are then.
    """
    up = edges(posts, conversation, key, parent)
    nodes = posts.select(F.col(conversation).alias("conversation"), F.col(key).alias("key")).distinct()
    known = nodes.join(up.withColumnRenamed("child", "key"), ["conversation", "key"], "left").select("conversation", "key", F.col("parent").alias("top"), F.when(F.col("parent").isNull(), F.array("key")).otherwise(F.array("parent", "key")).alias("path"))
    while True:
        known = written(known)
        if not known.where("top is not null").limit(1).count():
            break
        above = known.select("conversation", F.col("key").alias("top"), F.col("path").alias("head"), F.col("top").alias("higher"))
        longer = F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", F.slice("path", 2, (1 << 31) - 1)))
        known = known.join(above, ["conversation", "top"], "left").select("conversation", "key", F.col("higher").alias("top"), longer.alias("path"))
        once = F.reverse(F.array_distinct(F.reverse("path")))
        is_open = F.size(once) == F.size("path")
        if max_depth is not None:
            is_open &= F.size("path") <= max_depth
        known = known.select("conversation", "key", F.when(is_open, F.col("top")).alias("top"), once.alias("path"))
    return known.select("conversation", "key", F.get("path", F.lit(0)).alias("root"), (F.size("path") - 1).alias("depth"), "path")


def depths(posts: DataFrame, conversation: str, key: str, parent: str) -> DataFrame:
    """(conversation, key, root, depth) as `paths` has them, by doubling one pointer a post; no path is kept.

    A post that has climbed further than its conversation is large is on or below a cycle; only those conversations' paths are taken.
    """
    up = edges(posts, conversation, key, parent)
    nodes = posts.select(F.col(conversation).alias("conversation"), F.col(key).alias("key")).distinct()
    sizes = nodes.groupBy("conversation").agg(F.count("*").alias("size"))
    top = F.col("parent")
    known = nodes.join(up.withColumnRenamed("child", "key"), ["conversation", "key"], "left").join(sizes, "conversation")
    known = known.select("conversation", "key", "size", top.alias("top"), F.when(top.isNull(), F.col("key")).alias("root"), F.when(top.isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(False).alias("cyclic"))
    while True:
        known = written(known)
        if not known.where("top is not null").limit(1).count():
            break
        above = known.select("conversation", F.col("key").alias("top"), F.col("top").alias("higher"), F.col("root").alias("its_root"), F.col("depth").alias("further"), F.col("cyclic").alias("its_cyclic"))
        going = known.where("top is not null").join(above, ["conversation", "top"])
        far = F.col("depth") + F.col("further")
        lost = F.col("its_cyclic") | (F.col("higher").isNotNull() & (far > F.col("size")))
        going = going.select("conversation", "key", "size", F.when(~lost, F.col("higher")).alias("top"), F.col("its_root").alias("root"), far.alias("depth"), lost.alias("cyclic"))
        known = known.where("top is null").unionByName(going)
    odd = known.where("cyclic")
    plain = known.where("not cyclic").select("conversation", "key", "root", "depth")
    if not odd.limit(1).count():
        return plain
    some = posts.join(odd.select(F.col("conversation").alias(conversation)).distinct(), conversation, "left_semi")
    rest = paths(some, conversation, key, parent).join(odd.select("conversation", "key"), ["conversation", "key"], "left_semi")
    return plain.unionByName(rest.select("conversation", "key", "root", F.col("depth").cast("long").alias("depth")))


def paths_sql(view: str, conversation: str, key: str, parent: str) -> str:
    """The same as a recursive query, for spark.sql over a view; posts on or below a cycle have no row. Spark takes a number of levels, 2^31 - 1 at most."""
    return f"""
    WITH RECURSIVE walk(conversation, key, root, depth) MAX RECURSION LEVEL {(1 << 31) - 1} AS (
      SELECT p.{conversation}, p.{key}, p.{key}, 0 FROM {view} p LEFT JOIN {view} q ON p.{conversation} = q.{conversation} AND p.{parent} = q.{key} WHERE q.{key} IS NULL
      UNION ALL
      SELECT p.{conversation}, p.{key}, w.root, w.depth + 1 FROM {view} p JOIN walk w ON p.{conversation} = w.conversation AND p.{parent} = w.key
    ) SELECT * FROM walk"""


def thread_texts(posts: DataFrame, conversation: str, key: str, parent: str, body: str, max_chars: int) -> DataFrame:
    """(conversation, key, content): '[root] ...', '[context] ...', '[current] ...' parts of the path that fit."""
    path = paths(posts, conversation, key, parent).select("conversation", "key", "depth", F.posexplode("path").alias("pos", "at"))
    own = posts.select(F.col(conversation).alias("conversation"), F.col(key).alias("at"), F.col(body).alias("body"))
    kind = F.when(F.col("pos") == F.col("depth"), "current").when(F.col("pos") == 0, "root").otherwise("context")
    parts = path.join(own, ["conversation", "at"]).select("conversation", "key", F.struct("pos", text.labelled(kind, F.col("body")).alias("text")).alias("p"))
    whole = parts.groupBy("conversation", "key").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]).alias("parts"))
    return whole.select("conversation", "key", F.array_join(text.fit_parts(F.col("parts"), max_chars), "\n").alias("content"))


def conversation_stats(posts: DataFrame, conversation: str) -> DataFrame:
    sizes = posts.where(F.col(conversation).isNotNull()).groupBy(conversation).count()
    total = F.coalesce(F.sum("count"), F.lit(0))
    return sizes.agg(F.count("*").alias("n_conversations"), total.alias("n_posts"), F.coalesce(F.avg("count"), F.lit(0.0)).alias("avg_size"))
