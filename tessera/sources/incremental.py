"""Incremental re-runs: a manifest of input files with their hashes and the settings, and outputs per file.

A run lists its inputs, compares size and time with the manifest, hashes those that differ, and processes only files whose content or settings
changed. Outputs go to a folder of their own for each run, partitioned by input file; the manifest then says which folder holds a file's
output, so a file that is gone, or was processed anew, drops out by not being named any more. A manifest is published as a numbered file after the outputs are whole: a
run that fails leaves the last one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import file_hashes

_ENTRY = "path string, length long, modified long, sha256 string, settings string, output string"


class Incremental:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.path}/_manifests")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def manifest(self) -> DataFrame:
        """(path, length, modified, sha256, settings, output) of the last whole run."""
        for version in reversed(self._versions()):
            if self._fs.exists(self._path(f"{self.path}/_manifests/{version}/_SUCCESS")):
                return self.spark.read.schema(_ENTRY).json(f"{self.path}/_manifests/{version}")
        return self.spark.createDataFrame([], _ENTRY)

    def plan(self, inputs: str, settings: dict) -> DataFrame:
        """Input files with what the manifest says of them: `kept` (nothing to do) or to be processed. Contents are hashed only where size or time differ."""
        mark = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()
        listed = self.spark.read.format("binaryFile").load(inputs).select("path", "length", F.unix_millis("modificationTime").alias("modified"))
        old = self.manifest().withColumnsRenamed({"length": "old_length", "modified": "old_modified", "sha256": "old_sha256"})
        both = listed.join(old, "path", "left").withColumn("current", F.coalesce(F.col("settings") == mark, F.lit(False)))
        both = both.withColumn("same", F.coalesce((F.col("length") == F.col("old_length")) & (F.col("modified") == F.col("old_modified")), F.lit(False)))
        unsure = [r["path"] for r in both.where("not same or not current").select("path").collect()]  # names of the files to look at
        if unsure:
            hashes = file_hashes(self.spark, unsure).select("path", F.col("sha256").alias("new_sha256"))
            both = both.join(hashes, "path", "left")
        else:
            both = both.withColumn("new_sha256", F.lit(None).cast("string"))
        sha = F.coalesce("new_sha256", "old_sha256")
        kept = F.col("current") & F.coalesce(sha == F.col("old_sha256"), F.lit(False))
        return both.select("path", "length", "modified", sha.alias("sha256"), F.lit(mark).alias("settings"), F.when(kept, F.col("output")).alias("output"), kept.alias("kept"))

    def run(self, inputs: str, settings: dict, process: Callable[[DataFrame], DataFrame], read: Callable[[list[str]], DataFrame] | None = None) -> dict[str, int]:
        """process(rows with `_file`) -> rows that still have `_file`. Returns how many files were processed, kept and retracted."""
        files = [r.asDict() for r in self.plan(inputs, settings).collect()]
        before = {r["path"] for r in self.manifest().select("path").collect()}
        todo, version = [f["path"] for f in files if not f["kept"]], max(self._versions(), default=0) + 1
        if todo:
            folder = f"run-{uuid.uuid4().hex}"
            rows = read(todo) if read else self.spark.read.parquet(*todo)
            out = process(rows.withColumn("_file", F.col("_metadata.file_path")))
            out.withColumn("_id", F.sha2("_file", 256)).drop("_file").write.partitionBy("_id").parquet(f"{self.path}/{folder}")
            for f in files:
                f["output"] = f["output"] or folder
        gone = before - {f["path"] for f in files}
        if todo or gone:
            names = [c.split()[0] for c in _ENTRY.split(", ")]
            self.spark.createDataFrame([tuple(f[c] for c in names) for f in files], _ENTRY).coalesce(1).write.json(f"{self.path}/_manifests/{version}")
        return {"processed": len(todo), "kept": len(files) - len(todo), "retracted": len(gone)}

    def outputs(self) -> DataFrame | None:
        """The outputs of all files of the last run; None before the first."""
        entries = self.manifest().select("path", "output").collect()
        parts = []
        for folder in sorted({e["output"] for e in entries}):
            ids = [hashlib.sha256(e["path"].encode()).hexdigest() for e in entries if e["output"] == folder]
            at = self.spark.read.parquet(f"{self.path}/{folder}") if self._fs.exists(self._path(f"{self.path}/{folder}/_SUCCESS")) else None
            if at is not None and "_id" in at.columns:
                parts.append(at.where(F.col("_id").isin(ids)).drop("_id"))
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
