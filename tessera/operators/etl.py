"""Ingestion of text archives: validity, dedup, known-key skip, quoted texts, batches, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..scratch import written

TEXT_HINTS, ID_HINTS = ("text", "content", "message", "body", "tweet"), ("id", "key", "identifier")


def describe(df: DataFrame) -> DataFrame:
    """column, type, first value, and whether its name hints at a text or an id."""
    first = df.limit(1).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).first()
    rows = [(c, t, first[c] if first else None, any(h in c.lower() for h in TEXT_HINTS), any(h in c.lower() for h in ID_HINTS)) for c, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, type string, first_value string, text_hint boolean, id_hint boolean")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def valid(df: DataFrame, key: str, body: str) -> DataFrame:
    """Rows with an id (neither null, 0 nor '') and a text that isn't blank."""
    ident = F.col(key).cast("string")
    return df.where(ident.isNotNull() & ~ident.isin("0", "") & ~text.is_blank(F.col(body)))


def first_of_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def unknown(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def with_quoted(posts: DataFrame, key: str, quoted_key: str, body: str, order: str) -> DataFrame:
    """Posts with `quoted_text`; of repeated ids the last in order is quoted. Posts that quote nothing stay out of the join's hot null key."""
    source = posts.groupBy(F.col(key).alias("_q")).agg(F.max_by(body, order).alias("quoted_text"))
    return posts.join(source, F.col(quoted_key) == F.col("_q"), "left").drop("_q")


def quoted_in_conversation(posts: DataFrame, conversation: str, key: str, quoted_key: str, body: str, order: str) -> DataFrame:
    """Posts with `quoted_text` if the quoted post is in their own conversation."""
    source = posts.groupBy(F.col(conversation).alias("_c"), F.col(key).alias("_q")).agg(F.max_by(body, order).alias("quoted_text"))
    return posts.join(source, (F.col(conversation) == F.col("_c")) & (F.col(quoted_key) == F.col("_q")), "left").drop("_c", "_q")


def missing_quotes(posts: DataFrame, key: str, quoted_key: str) -> DataFrame:
    """Distinct (key, quoted key) whose quoted post is absent."""
    have = posts.select(F.col(key).alias(quoted_key))
    return posts.where(F.col(quoted_key).isNotNull()).join(have, quoted_key, "left_anti").select(key, quoted_key).distinct()


def processed(posts: DataFrame, body: str, quoted: str | None = None, max_chars: int = text.MAX_CHARS) -> DataFrame:
    """Adds `content` and `processing` (has_quotes, is_truncated, n_chars, character_difference); blank results go."""
    out = posts.withColumn("_c", text.combine(F.col(body), F.col(quoted) if quoted else None, max_chars))
    difference = F.length(F.coalesce(F.col(body), F.lit(""))) - F.col("_c.n_chars")
    out = out.withColumns({"content": F.col("_c.text"), "processing": F.struct("_c.has_quotes", "_c.is_truncated", "_c.n_chars", difference.alias("character_difference"))}).drop("_c")
    return out.where(~text.is_blank(F.col("content")))


def metadata(names: dict[str, str]) -> Column:
    """A struct of output name: source column; ids become strings, counts stay numbers, nulls stay null."""
    return F.struct(*[(F.col(src).cast("string") if out.endswith("_id") else F.col(src)).alias(out) for out, src in names.items()])


def enriched(df: DataFrame, body: str, provider: str, model: str) -> DataFrame:
    return df.withColumns({"provider": F.lit(provider), "model": F.lit(model), "tokens": text.token_estimate(F.col(body))})


def batched(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """row_index from 0 in the order, and batch_file. Rows are numbered inside their range of the order, then over the ranges' counts.

    The ranged rows are written once: another evaluation could cut the ranges elsewhere.
    """
    place = F.monotonically_increasing_id()
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    base = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("_p", part).join(F.broadcast(counts.select("_p", base.alias("_b"))), "_p").withColumn("row_index", (F.col("_b") + inside).cast("long"))
    return out.withColumn("batch_file", F.format_string("batch_%04d", F.floor(F.col("row_index") / size).cast("int"))).drop("_p", "_at", "_b")


def progress_stats(progress: DataFrame) -> DataFrame:
    e, s = F.coalesce("embedded", F.lit(False)), F.coalesce("embedding_stored", F.lit(False))
    return progress.agg(F.count("*").alias("total"), F.count_if(e).alias("embedded"), F.count_if(s).alias("stored"), F.count_if(e & s).alias("complete"), F.count_if(~(e & s)).alias("pending"))


def unprocessed(rows: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    done = progress.where(F.coalesce("embedded", F.lit(False)) & F.coalesce("embedding_stored", F.lit(False)))
    return rows.join(done.select(key), key, "left_anti")


def pending_batches(rows: DataFrame, progress: DataFrame, key: str) -> DataFrame:
    return unprocessed(rows, progress, key).select("batch_file").distinct()


def output_stats(rows: DataFrame, body: str, content: str) -> DataFrame:
    """Totals of a run: mean lengths before and after, and how many were truncated, quoted or shortened."""
    n0, n1 = F.length(body), F.length(content)
    return rows.agg(F.count("*").alias("n"), F.avg(n0).alias("avg_original"), F.avg(n1).alias("avg_processed"), F.count_if(F.col("processing.has_quotes")).alias("with_quotes"), F.count_if(F.col("processing.is_truncated")).alias("truncated"), F.avg((n0 - n1).cast("double")).alias("avg_reduction"))


def request_items(rows: DataFrame, body: str, content: str, extra: list[str]) -> DataFrame:
    """key, content and metadata as the embedding request has them; processing fields and extras stand beside the original text."""
    fields = [F.lit("parquet_import").alias("source"), F.col(body).alias("original_text"), "processing.has_quotes", "processing.is_truncated", "processing.character_difference", *extra]
    return rows.select("key", F.col(content).alias("content"), F.struct(*fields).alias("metadata"))


def manifest(batches: DataFrame, key: str) -> DataFrame:
    """One row per batch file: rows, first and last key."""
    return batches.groupBy("batch_file").agg(F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def progress_rows(batches: DataFrame, key: str, embedded: Column, stored: Column) -> DataFrame:
    """The rows a run appends to its progress table, which unprocessed(), pending_batches() and progress_stats() read."""
    return batches.select(F.col(key).alias("key"), "batch_file", embedded.alias("embedded"), stored.alias("embedding_stored"))


def sanitized(column: Column, kind: T.DataType) -> Column:
    """A value with every BIGINT in it, at any depth, as a string."""
    if isinstance(kind, T.LongType):
        return column.cast("string")
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[sanitized(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: sanitized(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: sanitized(v, kind.valueType))
    return column
