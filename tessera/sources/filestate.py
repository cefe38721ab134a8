"""Two data sources with their own bookkeeping of files.

`committed` is a sink with two-phase commit. Every task writes one hidden part, whatever becomes of it; when all tasks are done, the driver publishes a
numbered manifest of the parts that the successful attempts wrote. Readers take the parts that manifests name (`committed_rows`), so
a failed task, a speculative twin or an aborted job leaves nothing to be read; what they left on disk is deleted at commit or abort.

`filequeue` is a stream of files whose state is in their names: x.pending.ext, x.processing.ext, x.completed.ext, x.failed.ext. A micro-batch claims
pending files, oldest first, and writes its claim down before Spark sees the offset; when Spark commits the batch, they are completed. Claims that
weren't written down go back to pending at the start. A batch that runs again reads the files of its claim again. Files that can't be
read become failed if `onError` is 'skip'; else they fail the query.

Both reach files through Arrow's file systems, so local folders, HDFS and object stores work; where a rename is a copy, keep files small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path.rstrip("/"))


def _names(fs: pafs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File)


def _write(fs: pafs.FileSystem, path: str, value) -> None:
    """A whole file or none: written beside and renamed."""
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder)
    temp = f"{folder}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(json.dumps(value).encode())
    fs.move(temp, f"{folder}/{name}")


def _read(fs: pafs.FileSystem, path: str):
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


# ---- the committed sink ----


class Part(WriterCommitMessage):
    def __init__(self, name: str, rows: int):
        self.name, self.rows = name, rows


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema, overwrite: bool, compression: str, rows: int):
        self.path, self.schema, self.overwrite, self.compression, self.rows = path, to_arrow_schema(schema), overwrite, compression, rows
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One part a task, streamed row group by row group; the name holds the job and a random part, so attempts never meet."""
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/_parts")
        name, n = f"{self.job}-{uuid.uuid4().hex}.parquet", 0
        held: list[pa.RecordBatch] = []
        with fs.open_output_stream(f"{root}/_parts/{name}") as sink, pq.ParquetWriter(sink, self.schema, compression=self.compression) as out:

            def put() -> None:
                if held:
                    out.write_table(pa.Table.from_batches(held).cast(self.schema), row_group_size=self.rows)
                    held.clear()

            for batch in iterator:
                held.append(batch)
                n += batch.num_rows
                if sum(b.num_rows for b in held) >= self.rows:
                    put()
            put()
        return Part(name, n)

    def _clean(self, keep: set[str]) -> None:
        fs, root = _open(self.path)
        for name in _names(fs, f"{root}/_parts"):
            if name.startswith(self.job) and name not in keep:
                fs.delete_file(f"{root}/_parts/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.path)
        parts = {m.name: m.rows for m in messages if m is not None}
        last = max((int(x) for x in _names(fs, f"{root}/_manifests") if x.isdigit()), default=0)
        _write(fs, f"{root}/_manifests/{last + 1:012d}", {"job": self.job, "overwrite": self.overwrite, "parts": {k: v for k, v in parts.items() if v}})
        self._clean({k for k, v in parts.items() if v})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(set())


class Committed(DataSource):
    """df.write.format('committed').mode('append').save(path); options: compression, rows (of a row group)."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite, self.options.get("compression", "snappy"), int(self.options.get("rows", 10_000)))


def manifests(path: str) -> list[dict]:
    """The manifests that count, oldest first: from the last one that overwrites on."""
    fs, root = _open(path)
    found: list[dict] = []
    for name in _names(fs, f"{root}/_manifests"):
        if name.isdigit():
            one = _read(fs, f"{root}/_manifests/{name}")
            found = [one] if one["overwrite"] else [*found, one]
    return found


def committed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed writes."""
    parts = [f"{path.rstrip('/')}/_parts/{name}" for m in manifests(path) for name in m["parts"]]
    if not parts:
        raise ValueError(f"{path} holds no committed rows")
    return spark.read.parquet(*parts)


def vacuum(path: str) -> int:
    """Delete parts that no manifest that counts names; no write may be running."""
    fs, root = _open(path)
    used = {name for m in manifests(path) for name in m["parts"]}
    gone = [n for n in _names(fs, f"{root}/_parts") if n not in used]
    for name in gone:
        fs.delete_file(f"{root}/_parts/{name}")
    return len(gone)


# ---- the file-state queue ----

STATES = ("pending", "processing", "completed", "failed")


def state_of(name: str) -> tuple[str, str, str] | None:
    """(stem, state, extension) of x.state.ext."""
    parts = name.rsplit(".", 2)
    return (parts[0], parts[1], parts[2]) if len(parts) == 3 and parts[1] in STATES else None


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, schema, files: int, skip: bool):
        self.path, self.schema, self.files, self.skip = path, to_arrow_schema(schema), files, skip
        self.recovered = False

    def _move(self, fs, root: str, stem: str, ext: str, old: str, new: str) -> bool:
        """Rename; False if the file isn't in the old state any more."""
        at = f"{root}/{stem}.{old}.{ext}"
        if fs.get_file_info(at).type != pafs.FileType.File:
            return False
        fs.move(at, f"{root}/{stem}.{new}.{ext}")
        return True

    def _claims(self, fs, root: str) -> list[int]:
        return sorted(int(n) for n in _names(fs, f"{root}/_claims") if n.isdigit())

    def _listed(self, fs, root: str, state: str) -> list[tuple[str, str]]:
        infos = [f for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.type == pafs.FileType.File]
        found = [(f.mtime_ns or 0, f.base_name) for f in infos if (s := state_of(f.base_name)) and s[1] == state]
        return [(state_of(n)[0], state_of(n)[2]) for _, n in sorted(found)]

    def _recover(self, fs, root: str) -> None:
        """Files that are processing without a claim were never handed to Spark."""
        known = {tuple(f) for k in self._claims(fs, root) for f in _read(fs, f"{root}/_claims/{k:012d}")}
        for stem, ext in self._listed(fs, root, "processing"):
            if (stem, ext) not in known:
                self._move(fs, root, stem, ext, "processing", "pending")
        self.recovered = True

    def initialOffset(self) -> dict:
        return {"claim": 0}

    def latestOffset(self) -> dict:
        fs, root = _open(self.path)
        if not self.recovered:
            self._recover(fs, root)
        last = max(self._claims(fs, root), default=0)
        mine = [f for f in self._listed(fs, root, "pending")[: self.files] if self._move(fs, root, *f, "pending", "processing")]
        if mine:
            _write(fs, f"{root}/_claims/{last + 1:012d}", mine)
            last += 1
        return {"claim": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, root = _open(self.path)
        claims = range(start["claim"] + 1, end["claim"] + 1)
        return [_File(f"{stem}\n{ext}") for k in claims for stem, ext in _read(fs, f"{root}/_claims/{k:012d}")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        stem, ext = partition.name.split("\n")
        try:
            table = self._table(fs, root, stem, ext)
        except Exception:
            if not self.skip:
                raise
            self._move(fs, root, stem, ext, "processing", "failed")
            return
        yield from table.to_batches(max_chunksize=10_000)

    def _table(self, fs, root: str, stem: str, ext: str) -> pa.Table:
        state = next((s for s in ("processing", "completed") if fs.get_file_info(f"{root}/{stem}.{s}.{ext}").type == pafs.FileType.File), None)
        if state is None:
            raise FileNotFoundError(f"{stem} is neither processing nor completed")
        with fs.open_input_file(f"{root}/{stem}.{state}.{ext}") as f:
            if ext == "parquet":
                found = pq.read_table(f, columns=self.schema.names)
            else:
                import pyarrow.json as pj

                found = pj.read_json(f, parse_options=pj.ParseOptions(explicit_schema=self.schema, unexpected_field_behavior="ignore"))
        return found.select(self.schema.names).cast(self.schema)

    def commit(self, end: dict) -> None:
        fs, root = _open(self.path)
        for k in self._claims(fs, root):
            if k <= end["claim"]:
                for stem, ext in _read(fs, f"{root}/_claims/{k:012d}"):
                    self._move(fs, root, stem, ext, "processing", "completed")

    def stop(self) -> None:
        pass


class FileQueue(DataSource):
    """spark.readStream.format('filequeue').schema(...).load(path); options: files (claimed by a micro-batch), onError ('fail' or 'skip').
    Files end in .parquet, or else hold JSON lines. One query reads a folder at a time."""

    @classmethod
    def name(cls) -> str:
        return "filequeue"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], schema, int(self.options.get("files", 100)), self.options.get("onError", "fail") == "skip")


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(Committed)
    spark.dataSource.register(FileQueue)
