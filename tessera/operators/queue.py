"""The durable write queue's states as plan functions. Rows: key, status, retry_count, created_at, error_message, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import latest

PENDING, PROCESSING, FAILED, MAX_RETRIES, DEQUEUE = "pending", "processing", "failed", 3, 1000
LIMITS = {"failed": 1000, "pending": 10_000, "processing": 100}


def enqueue(queue: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Insert or replace by key; a replaced row starts anew."""
    new = latest(rows, "key", order).withColumns({"status": F.lit(PENDING), "retry_count": F.lit(0), "error_message": F.lit(None).cast("string")})
    return queue.join(new, "key", "left_anti").unionByName(new.select(*queue.columns))


def dequeue(queue: DataFrame, n: int = DEQUEUE) -> DataFrame:
    return queue.where(F.col("status") == PENDING).orderBy("created_at", "key").limit(n)


def transition(queue: DataFrame, outcomes: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """outcomes (key, ok, error): stored rows leave; others go back to pending with one retry more, or fail at the limit."""
    joined = queue.join(outcomes, "key", "left").where(~F.coalesce("ok", F.lit(False)))
    tried, left = F.col("ok").isNotNull(), F.col("retry_count") < max_retries
    status = F.when(~tried, F.col("status")).when(left, PENDING).otherwise(FAILED)
    return joined.withColumns({"status": status, "retry_count": F.when(tried & left, F.col("retry_count") + 1).otherwise(F.col("retry_count")), "error_message": F.when(tried, F.col("error")).otherwise(F.col("error_message"))}).select(*queue.columns)


def recover(queue: DataFrame) -> DataFrame:
    return queue.withColumn("status", F.when(F.col("status") == PROCESSING, PENDING).otherwise(F.col("status")))


def retry_failed(queue: DataFrame) -> DataFrame:
    hit = F.col("status") == FAILED
    return queue.withColumns({"retry_count": F.when(hit, 0).otherwise(F.col("retry_count")), "error_message": F.when(hit, F.lit(None).cast("string")).otherwise(F.col("error_message")), "status": F.when(hit, PENDING).otherwise(F.col("status"))})


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in (PENDING, PROCESSING, FAILED)])


def health(counts: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    issues = F.array_compact(F.array(*[F.when(F.col(s) > n, F.concat(F.lit(f"{s}: "), F.col(s).cast("string"))) for s, n in (limits or LIMITS).items()]))
    return counts.withColumn("issues", F.array_join(issues, "; ")).withColumn("healthy", F.col("issues") == "")


def retry_delay_s(attempt: Column, retry_after_s: Column | None = None, base_s: int = 30) -> Column:
    """30 s doubled per attempt, or the server's wish but 30 s at least."""
    own = F.lit(base_s) * F.pow(F.lit(2), attempt)
    return own if retry_after_s is None else F.coalesce(F.greatest(retry_after_s, F.lit(base_s)).cast("double"), own)


def status_class(code: Column) -> Column:
    return F.when(code.isin(429, 420, 503), "rate_limited").when(code.between(400, 499), "permanent").when(code >= 500, "transient").otherwise("ok")


def keep_newest(files: DataFrame, n: int, mtime: str, tie: str) -> DataFrame:
    """Files beyond the newest n."""
    kept = files.select(tie).join(files.orderBy(F.desc(mtime), tie).limit(n).select(F.col(tie).alias("_k")), F.col(tie) == F.col("_k"), "left_anti")
    return files.join(kept, tie, "left_semi")


def due(queue: DataFrame, now: Column, n: int, base_s: int = 30) -> DataFrame:
    """Pending rows whose retry time has come, the earliest first. retry_at: created_at plus the delay of their retries (none for the first try)."""
    wait = F.when(F.col("retry_count") > 0, retry_delay_s(F.col("retry_count") - 1, base_s=base_s)).otherwise(0.0)
    at = F.timestamp_micros(F.unix_micros(F.col("created_at").cast("timestamp")) + (wait * 1_000_000).cast("long"))
    ready = queue.where(F.col("status") == PENDING).withColumn("retry_at", at).where(F.col("retry_at") <= now)
    return ready.orderBy("retry_at", "key").limit(n)
