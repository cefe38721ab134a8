"""Scans: typed readers that tolerate what the formats allow."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEDIA = "media_id string, tweet_id string, media_url string, media_type string, width string, height string, archive_upload_id string, updated_at string"
CALLS = "id string, timestamp timestamp, provider string, model string, inputTokens long, outputDimension int, latencyMs double, success boolean, error string"
TEXTS = "key string, text string, metadata string, created_at timestamp"


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n in a stated order; a bare limit would not be repeatable."""
    return df.orderBy(*order).limit(n)


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Bad lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def wide_vectors(df: DataFrame, prefix: str = "v") -> DataFrame:
    """Columns v0..vn back into `vector`; the dimension is read off the names; metadata JSON that doesn't parse becomes {}."""
    names = sorted((c for c in df.columns if c[len(prefix) :].isdigit() and c.startswith(prefix)), key=lambda c: int(c[len(prefix) :]))
    if [int(c[len(prefix) :]) for c in names] != list(range(len(names))) or not names:
        raise ValueError("vector columns must be numbered from 0 without gaps")
    out = df.withColumn("vector", F.array(*names).cast("array<float>")).drop(*names)
    return out.withColumn("metadata", F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}")))) if "metadata" in df.columns else out


def csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Quoted, multi-line CSV, one file or a folder; values are trimmed and rows without a required value go."""
    reader = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", ignoreCorruptFiles=True)
    df = reader.csv(path)
    df = df.select(*[F.trim(c).alias(c) for c in df.columns])
    return df.where(" and ".join(f"coalesce({c}, '') <> ''" for c in required))


def media_rows(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, MEDIA, ["media_id", "tweet_id", "media_url"]).withColumn("key", F.concat_ws("_", "tweet_id", "media_id"))


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """Base names without extension, with size and time, of a folder's files; contents aren't read."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("id"), "path", "length", "modificationTime")


def queue_files(files: DataFrame) -> DataFrame:
    """Counts and bytes per state in names like x.pending.parquet."""
    state = F.regexp_extract("path", r"\.(pending|processing|completed|failed)\b", 1)
    return files.groupBy(F.when(state == "", "other").otherwise(state).alias("state")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def queue_span(files: DataFrame) -> DataFrame:
    """Files, bytes, and the oldest and newest by time (ties by path)."""
    at = F.struct("modificationTime", "path")
    return files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min_by("path", at).alias("oldest"), F.max_by("path", at).alias("newest"))


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, sha256) of a folder's files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_count(spark: SparkSession, *paths: str) -> int:
    """Rows by the Parquet footers."""
    return spark.read.parquet(*paths).count()


def text_lookup(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored texts of the asked keys; of repeated keys the last by time."""
    hit = texts.join(keys.select("key").distinct(), "key", "left_semi")
    return hit.groupBy("key").agg(F.max_by(F.struct(*[c for c in texts.columns if c != "key"]), F.struct("created_at", "text")).alias("t")).select("key", "t.*")


def text_exists(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Each asked key with `found`."""
    hit = texts.select("key").distinct().withColumn("_hit", F.lit(True))
    return keys.select("key").join(hit, "key", "left").select("key", F.coalesce("_hit", F.lit(False)).alias("found"))


def recent_calls(spark: SparkSession, path: str, n: int) -> DataFrame:
    return jsonl(spark, path, CALLS).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def text_stats(texts: DataFrame) -> DataFrame:
    return texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def merged_metadata(rows: DataFrame, order: list[str]) -> DataFrame:
    """(key, metadata): of repeated keys the last in order."""
    return rows.groupBy("key").agg(F.max_by("metadata", F.struct(*order)).alias("metadata"))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(part, pos, vector) from .npy files of little-endian float32 matrices, as sinks.npy writes them."""

    def parse(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                x = np.load(io.BytesIO(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(range(len(x)), pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["part", "pos", "vector"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInArrow(parse, "part string, pos long, vector array<float>")


def props(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn(column, F.from_json(column, schema))


def schema_json(df: DataFrame) -> dict:
    return json.loads(df.schema.json())
