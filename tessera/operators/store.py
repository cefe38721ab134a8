"""A collection of keyed vectors: pure plan functions, and VectorTable, which keeps one as Parquet versions.

Rows are (key STRING, vector ARRAY<FLOAT>, metadata STRUCT). A version is a base folder and the deltas written since, in order. A
write adds one folder and then publishes a numbered version file, which must not exist yet: readers see whole versions, and a
failed write leaves the last one. Of two writers at once one is first; the other takes the new version as its ground: its delta goes on
top as it is if the keys of the deltas published meanwhile are others, or if it doesn't depend on what was there (upsert and delete); if it does
(metadata), it is made anew. Numbers are given by the file system's exclusive create, so a store without one needs a single writer.
Folders are deleted by `vacuum` alone.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors

KEY_MAX, INSERT_MAX = 255, 10_000


def valid_rows(rows: DataFrame, dim: int, key: str = "key", vector: str = "vector") -> DataFrame:
    return rows.where(F.length(key).between(1, KEY_MAX) & vectors.is_valid(F.col(vector), dim))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in the order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(table: DataFrame, rows: DataFrame, key: str = "key", order: list[str] | None = None) -> DataFrame:
    """Rows replace those of the same key; within rows the last in `order` wins. One anti join, no window over the table."""
    new = latest(rows, key, order) if order else rows.dropDuplicates([key])
    return table.join(new, key, "left_anti").unionByName(new.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def delete_report(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """requested and deleted counts."""
    asked = keys.select(key).distinct()
    hit = asked.join(table.select(key), key, "left_semi")
    return asked.agg(F.count("*").alias("requested")).join(hit.agg(F.count("*").alias("deleted")), F.lit(True))


def replace_metadata(table: DataFrame, updates: DataFrame, key: str = "key", metadata: str = "metadata") -> DataFrame:
    """The whole metadata object of matching keys is replaced; null updates too."""
    new = updates.select(key, F.col(metadata).alias("_new"), F.lit(True).alias("_hit"))
    return table.join(new, key, "left").withColumn(metadata, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(metadata))).drop("_new", "_hit")


def exists(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Each asked key with `found`."""
    hit = table.select(key).distinct().withColumn("_hit", F.lit(True))
    return keys.select(key).join(hit, key, "left").select(key, F.coalesce("_hit", F.lit(False)).alias("found"))


def stats(table: DataFrame, vector: str = "vector") -> DataFrame:
    return table.agg(F.count("*").alias("n_points"), F.max(F.size(vector)).cast("int").alias("dimension"))


def id_bounds(table: DataFrame, point_id: str) -> DataFrame:
    return table.agg(F.min(point_id).alias("min_id"), F.max(point_id).alias("max_id"))


def scroll(table: DataFrame, key: str, limit: int, after=None) -> DataFrame:
    """A page of rows after a cursor key, in key order."""
    rows = table if after is None else table.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def range_scroll(table: DataFrame, point_id: str, low: int, high: int) -> DataFrame:
    return table.where(F.col(point_id).between(low, high))


def lookup(table: DataFrame, keys: list, key: str = "key") -> DataFrame:
    return table.where(F.col(key).isin(keys))


def beyond_first(table: DataFrame, point_id: str, n: int) -> DataFrame:
    """What a keep-first-n delete removes: rows after the n smallest ids. The bound comes from a top-n, not a global sort."""
    kept = table.select(point_id).orderBy(point_id).limit(n)
    edge = kept.agg(F.max(point_id).alias("_edge"))
    return table.join(F.broadcast(edge), F.col(point_id) > F.col("_edge")).drop("_edge") if n > 0 else table


def point_id(key: Column) -> Column:
    """BIGINT of a numeric key, else null; the key stays a string."""
    return key.try_cast("bigint")


def mismatches(table: DataFrame, id_column: str, key_column: str) -> DataFrame:
    """Counts of points whose key is missing, equals the id, or differs from it."""
    key, same = F.col(key_column), F.col(id_column).cast("string") == F.col(key_column)
    return table.agg(F.count("*").alias("total"), F.count_if(key.isNull()).alias("missing_key"), F.count_if(same).alias("matching"), F.count_if(~same).alias("mismatched"))


def rekey(table: DataFrame, id_column: str, key_column: str) -> DataFrame:
    """Mismatched points under the id their key spells."""
    return table.where(F.col(id_column).cast("string") != F.col(key_column)).withColumn(id_column, point_id(F.col(key_column)))


def keys(table: DataFrame, key: str, limit: int, after=None) -> DataFrame:
    """A page of keys in order; no vectors are read."""
    return scroll(table.select(key), key, limit, after)


UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def point_ref(key: Column) -> Column:
    """struct(id, uuid, key): a number, a UUID (in lower case) or neither; the key itself stays as it is."""
    return F.struct(point_id(key).alias("id"), F.when(key.rlike(UUID), F.lower(key)).alias("uuid"), key.alias("key"))


class Conflict(RuntimeError):
    """Another writer published the version first."""


class VectorTable:
    #: Deltas that are folded into a new base when they are so many.
    COMPACT = 32
    #: Times that a change is published anew after others came first.
    ATTEMPTS = 20
    #: Seconds after which a version file that isn't whole counts as left by a crash.
    GRACE = 3.0

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def _manifest(self, version: int) -> dict | None:
        """None for a version file that a crash cut off."""
        lines = self.spark.read.text(f"{self.path}/_versions/{version:012d}", wholetext=True).collect()
        try:
            return json.loads(lines[0][0]) if lines else None
        except ValueError:
            return None

    def _age(self, version: int) -> float:
        at = self._path(f"{self.path}/_versions/{version:012d}")
        return time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000

    def _current(self) -> dict | None:
        """The newest whole version. One that isn't whole yet may still be written: it gets GRACE seconds."""
        versions = self.versions()
        for version in reversed(versions):
            found = self._manifest(version)
            while not found and version == versions[-1] and self._age(version) < self.GRACE:
                time.sleep(0.2)
                found = self._manifest(version)
            if found:
                return found | {"version": version, "last": versions[-1]}
        return None

    def _publish(self, base: str, deltas: list[str], after: int) -> None:
        """The version after `after`; Conflict if it is there already."""
        at = self._path(f"{self.path}/_versions/{after + 1:012d}")
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            raise Conflict(f"version {after + 1} of {self.path} is there already") from e
        out.write(bytearray(json.dumps({"base": base, "deltas": deltas}).encode()))
        out.close()

    def _add(self, df: DataFrame, kind: str) -> str:
        """Rows sorted by key, with bloom filters on it, so lookups skip files and row groups."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{folder}")
        return folder

    def _checked(self, df: DataFrame) -> DataFrame:
        if df.where(~vectors.is_valid(F.col("vector"), self.dim)).limit(1).count():
            raise ValueError(f"vectors must have {self.dim} finite components")
        return df

    def read(self, version: int | None = None) -> DataFrame:
        current = self._current() if version is None else self._manifest(version)
        if current is None:
            raise ValueError(f"{self.path} holds no collection")
        base = self.spark.read.parquet(f"{self.path}/{current['base']}")
        if not current["deltas"]:
            return base
        parts = [self.spark.read.parquet(f"{self.path}/{d}").withColumn("_seq", F.lit(i)) for i, d in enumerate(current["deltas"])]
        changes = latest(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), "key", ["_seq"])
        kept = base.join(changes.select("key"), "key", "left_anti")
        # Deletes have keys alone.
        changes = changes.where("not _deleted").select(*[F.col(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema])
        return kept.unionByName(changes)

    def _last(self) -> int:
        return max(self.versions(), default=0)

    def write(self, df: DataFrame) -> None:
        """A whole new collection; it replaces what others publish meanwhile."""
        folder = self._add(self._checked(df), "base")
        for _ in range(self.ATTEMPTS):
            try:
                return self._publish(folder, [], self._last())
            except Conflict:
                continue
        raise Conflict(f"{self.path} changes too fast")

    def _shared_keys(self, delta: str, others: list[str]) -> bool:
        """Whether deltas published meanwhile touch a key of this one; files of other keys are skipped by their bloom filters and bounds."""
        read = lambda d: self.spark.read.parquet(f"{self.path}/{d}").select("key")
        return bool(others) and read(delta).join(reduce(DataFrame.unionByName, [read(d) for d in others]), "key", "left_semi").limit(1).count() > 0

    def _change(self, make, deleted: bool, depends: bool = False) -> str | None:
        """Publish the delta make(version) on top of the newest version. depends: its rows are made of the collection's own."""
        ground, folder = self._current(), None
        for _ in range(self.ATTEMPTS):
            if ground is None and deleted:
                return None
            if folder is None:
                rows = make(ground["version"] if ground else None)
                folder = self._add(rows.withColumn("_deleted", F.lit(deleted)) if ground else rows, "delta" if ground else "base")
            try:
                if ground is None:
                    self._publish(folder, [], self._last())
                else:
                    self._publish(ground["base"], [*ground["deltas"], folder], ground["last"])
                    if len(ground["deltas"]) + 1 >= self.COMPACT:
                        self.compact()
                return folder
            except Conflict:
                found = self._current()
                if found is None:
                    continue
                fresh = ground is None or found["base"] != ground["base"]
                if fresh or (depends and self._shared_keys(folder, [d for d in found["deltas"] if d not in ground["deltas"]])):
                    folder = None
                ground = found
        raise Conflict(f"{self.path} changes too fast")

    def compact(self) -> bool:
        """A new base of the newest version; False if others published meanwhile, whose version stays as it is."""
        current = self._current()
        try:
            self._publish(self._add(self.read(current["version"]), "base"), [], current["last"])
        except Conflict:
            return False
        return True

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Costs what the rows cost; the collection isn't rewritten. Returns how many went in."""
        rows = latest(rows, "key", order) if order else rows.dropDuplicates(["key"])
        rows = self._checked(rows.drop(*[c for c in order or [] if c not in ("key", "vector", "metadata")]))
        return self.spark.read.parquet(f"{self.path}/{self._change(lambda _: rows, False)}").count()

    def delete(self, keys: DataFrame) -> dict[str, int]:
        """{requested, deleted}: distinct keys asked for, and those that were there."""
        asked = keys.select("key").where("key is not null").distinct()
        ground = self._current()
        if ground is None:
            return {"requested": asked.count(), "deleted": 0}
        counts = delete_report(self.read(ground["version"]), asked).first()
        self._change(lambda _: asked, True)
        return {"requested": counts["requested"], "deleted": counts["deleted"]}

    def replace_metadata(self, updates: DataFrame) -> dict[str, int]:
        """{updated, failed}: keys whose metadata was replaced, and keys that the collection doesn't hold."""
        asked = updates.where("key is not null").dropDuplicates(["key"])
        if self._current() is None:
            return {"updated": 0, "failed": asked.count()}

        def make(version):
            found = self.read(version)
            return replace_metadata(found.join(asked.select("key"), "key", "left_semi"), asked)

        folder = self._change(make, False, depends=True)
        updated = self.spark.read.parquet(f"{self.path}/{folder}").count()
        return {"updated": updated, "failed": asked.count() - updated}

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that the last `keep` versions don't use, and older version files; how many folders went. No reader of an older version may run."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for m in [self._manifest(v)] if m for f in [m["base"], *m["deltas"]]}
        gone = [f.getPath() for f in self._fs.listStatus(self._path(self.path)) if f.getPath().getName().startswith(("base-", "delta-")) and f.getPath().getName() not in used]
        for path in [*gone, *(self._path(f"{self.path}/_versions/{v:012d}") for v in versions[:-keep])]:
            self._fs.delete(path, True)
        return len(gone)

    def __getattr__(self, name):
        if name in ("exists", "stats", "scroll", "range_scroll", "lookup", "id_bounds", "keys"):
            return lambda *a, **b: globals()[name](self.read(), *a, **b)
        raise AttributeError(name)


def partitions(table: DataFrame) -> DataFrame:
    """Rows per partition of the scan."""
    return table.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
