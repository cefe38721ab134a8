"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Only on a local master (tests), that may be unset and a temporary folder is used."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessera-"))
        base = _local[0]
    if not _made:
        atexit.register(clean)
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean() -> None:
    """Delete this process's scratch folders."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


#: Settings of scratch writes: shuffle files go when an execution has ended, and Arrow batches, of which an executor holds several, are small.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def written(df: DataFrame) -> DataFrame:
    """Write df to a scratch folder and read it back: cuts the lineage and survives lost executors. Its shuffle files go when it is written."""
    spark = df.sparkSession
    path, before = folder(spark), {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a written table before the session ends; nothing may read it later."""
    _delete(df.sparkSession, df._scratch)
