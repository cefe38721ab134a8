"""Bulk import of vectors, embedding with storage, and what a run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.embed import Embedder, generate
from ..scratch import dropped, written
from ..sources import readers
from .store import KEY_MAX, VectorTable, point_ref


def importable(rows: DataFrame, dim: int) -> DataFrame:
    """Rows of an export, arrays or wide columns, with `ok`: a key of 1 to 255 characters and a valid vector."""
    rows = rows if "vector" in rows.columns else readers.wide_vectors(rows)
    rows = rows.withColumn("key", F.col("key").cast("string"))
    return rows.withColumn("ok", F.coalesce(F.length("key").between(1, KEY_MAX), F.lit(False)) & vectors.is_valid(F.col("vector"), dim))


def bulk_import(spark: SparkSession, paths: list[str], table: VectorTable) -> DataFrame:
    """All valid rows of Parquet exports go to the table in one job, the last of a repeated key by file and row. Returns the profile per file."""
    rows = importable(spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")), table.dim)
    good = rows.where("ok")
    if good.limit(1).count():
        columns = [c for c in ("key", "vector", "metadata") if c in good.columns]
        table.upsert(good.select(*columns, "_file", "_row"), ["_file", "_row"])
    return profile(rows)


def profile(rows: DataFrame) -> DataFrame:
    """(file, n, imported, share): what each file brought."""
    per = rows.groupBy(F.col("_file").alias("file")).agg(F.count("*").alias("n"), F.count_if("ok").alias("imported"))
    return per.withColumn("share", F.col("imported") / F.col("n"))


def profile_summary(files: DataFrame) -> DataFrame:
    """Files, rows, mean rows a file and the share imported."""
    return files.agg(F.count("*").alias("files"), F.sum("n").alias("n"), F.avg("n").alias("avg_rows"), (F.sum("imported") / F.sum("n")).alias("share"))


def generate_and_store(rows: DataFrame, key: str, body: str, table: VectorTable, embedder: Embedder | None = None) -> int:
    """Embed the rows' texts and upsert them with the text as metadata; returns how many went in. Of a repeated key the smallest text that isn't blank
    counts. Texts are embedded once: counting, checking and storing read the vectors made."""
    once = rows.select(F.col(key).cast("string").alias("key"), F.col(body).alias("text")).where(F.col("key").isNotNull() & F.col("text").rlike(r"\S")).groupBy("key").agg(F.min("text").alias("text"))
    made = written(generate(once, "key", "text", embedder))
    n = 0
    if made.limit(1).count():
        n = table.upsert(made.join(once.select("key", F.struct("text").alias("metadata")), "key"))
    dropped(made)
    return n


def referenced(rows: DataFrame, key: str) -> DataFrame:
    """Adds `ref`: the point id a key spells."""
    return rows.withColumn("ref", point_ref(F.col(key).cast("string")))


def eta(done: int, total: int, seconds: float) -> dict:
    """Rate, share done and seconds left of a run."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"rate": rate, "percent": 100 * done / total if total else 100.0, "eta_seconds": (total - done) / rate if rate else None}
