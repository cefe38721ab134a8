"""Writers of collections and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_GROUPS = {"small": 1_000, "medium": 10_000, "large": 100_000}


def export_parquet(df: DataFrame, path: str, groups: str = "medium", compression: str = "snappy", mode: str = "errorifexists") -> None:
    """key, metadata (JSON), vector; the row group size bounds a writer's memory."""
    out = df.select(F.col("key").cast("string"), F.to_json("metadata").alias("metadata"), F.col("vector").cast("array<float>"))
    out.write.mode(mode).option("compression", compression).option("parquet.block.row.count.limit", ROW_GROUPS[groups]).parquet(path)


def export_jsonl(df: DataFrame, path: str, compression: str = "none", mode: str = "errorifexists") -> None:
    df.select("key", "vector", "metadata").write.mode(mode).option("compression", compression).json(path)


def export_csv(df: DataFrame, path: str, dim: int, mode: str = "errorifexists") -> None:
    """key, dim_0.., metadata; quotes are doubled."""
    columns = [F.col("vector")[i].alias(f"dim_{i}") for i in range(dim)]
    df.select("key", *columns, F.to_json("metadata").alias("metadata")).write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def wide(df: DataFrame, dim: int, prefix: str = "v") -> DataFrame:
    """One FLOAT column per dimension, metadata as JSON."""
    rest = [F.to_json(c).alias(c) if c == "metadata" else F.col(c) for c in df.columns if c != "vector"]
    return df.select(*rest, *[F.col("vector")[i].cast("float").alias(f"{prefix}{i}") for i in range(dim)])


def npy(df: DataFrame, path: str, rows_per_file: int = 100_000) -> DataFrame:
    """Real .npy files (little-endian float32 matrices) and the (part, pos, key, metadata) rows that go with them.

    Files are put in place by a rename, named by partition and number, so a task that runs again writes the same.
    """

    def write(batches):
        import io
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.create_dir(root)
        number, held, keys = 0, [], []

        def place():
            nonlocal number
            name = f"{root}/part-{TaskContext.get().partitionId():05d}-{number:04d}.npy"
            temp = f"{root}/_{uuid.uuid4().hex}"
            out = io.BytesIO()
            np.save(out, np.array(held, "<f4"))
            with fs.open_output_stream(temp) as f:
                f.write(out.getvalue())
            fs.move(temp, name)
            number += 1
            rows = pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array(range(len(held)), pa.int64()), pa.array([k for k, _ in keys], pa.string()), pa.array([m for _, m in keys], pa.string())], ["part", "pos", "key", "metadata"])
            held.clear()
            keys.clear()
            return rows

        for batch in batches:
            for k, v, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append(v)
                keys.append((k, m))
                if len(held) == rows_per_file:
                    yield place()
        if held:
            yield place()

    return df.select(F.col("key").cast("string"), "vector", F.to_json("metadata")).mapInArrow(write, "part string, pos long, key string, metadata string")


def batch_files(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in one folder per batch_file."""
    df.write.mode(mode).partitionBy("batch_file").json(path)


def rewrite_metadata(df: DataFrame, updates: DataFrame, path: str) -> None:
    """Matching keys get the new metadata; written to another path, for a swap."""
    from ..operators.store import replace_metadata

    replace_metadata(df, updates).write.parquet(path)


def distinct_lines(df: DataFrame, path: str, *columns: str, mode: str = "append") -> None:
    """'a=..., b=...' lines."""
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    df.select(line.alias("value")).distinct().write.mode(mode).text(path)


def report(stats: DataFrame, title: str) -> str:
    """A small HTML page of one row of aggregates."""
    import html

    row = stats.first().asDict()
    cards = "".join(f"<tr><th>{html.escape(k)}</th><td>{html.escape(str(v))}</td></tr>" for k, v in row.items())
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{cards}</table>"


def report_table(rows: DataFrame, path: str, decimals: dict[str, int], mode: str = "errorifexists") -> None:
    """A benchmark report as CSV with fixed decimals, and the same rows as JSON beside it."""
    fixed = rows.select(*[F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double")).alias(c) if c in decimals else F.col(c) for c in rows.columns])
    fixed.write.mode(mode).option("header", True).csv(f"{path}/csv")
    rows.write.mode(mode).json(f"{path}/json")


def failed_items(rows: DataFrame, path: str) -> None:
    """Append what failed, one CSV line each."""
    rows.write.mode("append").option("header", True).csv(path)


def manifest(batches: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    from ..operators.etl import manifest as of

    of(batches, key).write.mode(mode).json(path)


def progress(rows: DataFrame, path: str) -> None:
    """Append progress rows; readers take a key as done once any row says so."""
    rows.write.mode("append").parquet(path)


def convert_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows read from compressed JSON lines as zstd Parquet, vectors as FLOAT arrays."""
    df.withColumn("vector", F.col("vector").cast("array<float>")).write.mode(mode).option("compression", "zstd").parquet(path)


def renamed(spark, path: str, names: dict[str, str]) -> None:
    """Give the single data file of each partition folder below path a name of its own beside them; the folders go. names: folder -> file name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder, name in names.items():
        inside = jvm.org.apache.hadoop.fs.Path(at, folder)
        files = [f.getPath() for f in fs.listStatus(inside) if not f.getPath().getName().startswith(("_", "."))]
        if len(files) != 1:
            raise ValueError(f"{folder} holds {len(files)} files")
        fs.rename(files[0], jvm.org.apache.hadoop.fs.Path(at, name))
        fs.delete(inside, True)
