"""Media columns: texts as 8-bit grey PNG members of archives, read back through a custom Spark data source.

Writing: each task stores its rows' payloads as members of archive files in the shared folder. A payload is the
UTF-8 text, padded with bytes 255 to a positive multiple of 576, as the samples of a 576-wide grey image. A file's
name is its task's partition and number, and it is put in place by a rename, so a task that runs again after a lost
executor only puts the same file there again. At the end of a file stands its directory (one fixed-size entry per
member: id, offset, length, checksum) and a footer that points to it.

Reading: the data source lists the folder's archives, plans partitions of byte ranges over them without opening
them, and each partition reads the directory entries of the members that start in its range and streams their
bytes as Arrow batches. A member that fails its checksum or cannot be read is tried again by its own offset, up to
`retries` times, without reading its neighbours again; then the read fails.

Defined cases: null and empty texts are one row of 576 bytes 255; null ids stay null; repeated rows are members of
their own; an empty table gives no rows; a very long text is a taller image. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common as C

WIDTH, ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 576, 32 << 20, 8 << 20, 4 << 20, 4
ENTRY, FOOT, MAGIC = "<qBqqI", "<qq8s", b"TSARCH01"
SCHEMA = "member_id long, media binary"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> bytes:
    """Samples of a non-interlaced 8-bit grey PNG with unfiltered lines, as to_png writes it; chunk checksums are verified."""
    if png[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, size = 8, [], (0, 0)
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


#: Hadoop's names of object stores and Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    scheme, mark, rest = uri.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else uri


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = arrow_uri(uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _store(folder: str, archive_bytes: int):
    def run(batches):
        fs, root = _open(folder)
        fs.create_dir(root)
        part, number = TaskContext.get().partitionId(), 0
        members: list[tuple[int | None, bytes]] = []
        size = 0

        def close():
            nonlocal number, size
            name = f"{root}/arc-{part:06d}-{number:05d}.tsa"
            hidden = f"{root}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(hidden) as out:
                at, entries = 0, []
                for key, blob in members:
                    out.write(blob)
                    entries.append(struct.pack(ENTRY, key or 0, key is None, at, len(blob), zlib.crc32(blob)))
                    at += len(blob)
                out.write(b"".join(entries))
                out.write(struct.pack(FOOT, at, len(entries), MAGIC))
            fs.move(hidden, name)
            number, size, n = number + 1, 0, len(members)
            members.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "members"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                members.append((key.as_py(), to_png(payload(text.as_py()))))
                size += len(members[-1][1])
                if size >= archive_bytes:
                    yield close()
        if members:
            yield close()

    return run


def store(docs: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the documents' payloads as archives; returns the folder (below the shared one unless given)."""
    folder = folder or C.folder(docs.sparkSession)
    fs, root = _open(folder)
    fs.create_dir(root)
    done = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_store(folder, archive_bytes), "archive string, members long")
    done.agg(F.sum("members")).first()
    return folder


class Span(InputPartition):
    def __init__(self, archive: str, size: int, lo: int, hi: int):
        self.archive, self.size, self.lo, self.hi = archive, size, lo, hi


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self):
        fs, root = _open(self.folder)
        files = fs.get_file_info(pafs.FileSelector(root))
        return [Span(f.path, f.size, lo, min(lo + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".tsa") for lo in range(0, f.size, self.range_bytes)] or [Span("", 0, 0, 0)]

    def _member(self, fs, span, offset: int, size: int, crc: int) -> bytes:
        for left in range(self.retries, -1, -1):
            try:
                with fs.open_input_file(span.archive) as f:
                    blob = f.read_at(size, offset)
                if len(blob) == size and zlib.crc32(blob) == crc:
                    return blob
                raise OSError(f"{span.archive} at {offset}: the member is damaged")
            except OSError:
                if not left:
                    raise
                time.sleep(0.05 * (self.retries - left + 1))

    def read(self, span):
        if not span.archive:
            return
        fs, _ = _open(self.folder)
        with fs.open_input_file(span.archive) as f:
            start, n, magic = struct.unpack(FOOT, f.read_at(struct.calcsize(FOOT), span.size - struct.calcsize(FOOT)))
            if magic != MAGIC:
                raise OSError(f"{span.archive} is no archive")
            entries = [e for e in struct.iter_unpack(ENTRY, f.read_at(n * struct.calcsize(ENTRY), start)) if span.lo <= e[2] < span.hi]
            keys, blobs, size = [], [], 0
            for key, null, offset, length, crc in entries:
                try:
                    blob = f.read_at(length, offset)
                except OSError:
                    blob = b""
                if len(blob) != length or zlib.crc32(blob) != crc:
                    blob = self._member(fs, span, offset, length, crc)
                keys.append(None if null else key)
                blobs.append(blob)
                size += length
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["member_id", "media"])
                    keys, blobs, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["member_id", "media"])


class ArchiveSource(DataSource):
    """spark.read.format("tessera_archive").option("rangeBytes", n).option("retries", n).load(folder)"""

    @classmethod
    def name(cls):
        return "tessera_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def read(spark, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("tessera_archive").options(**options).load(folder)


def feature(samples: bytes) -> str:
    """Rows, mean sample and a 64-bit average hash of the image (8 by 8 cells against their mean), from the samples alone."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    edges = np.linspace(0, len(rows), 9).astype(int)
    down = np.stack([rows[a : max(b, a + 1)].mean(0) if a < len(rows) else rows[-1].astype(float) for a, b in zip(edges[:-1], edges[1:])])
    cells = down.reshape(8, 8, WIDTH // 8).mean(2)
    bits = (cells > cells.mean()).ravel()
    return f"{len(rows)}x{WIDTH}:{rows.mean():.4f}:{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _describe(batches):
    for batch in batches:
        rows = []
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            samples = from_png(media)
            bare = len(samples.rstrip(b"\xff"))
            rows.append((key, bare, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def described(spark, folder: str, **options) -> DataFrame:
    """One row per member, all from the bytes read back. UTF-8 never holds a byte 255, so the padding is told from the text."""
    return read(spark, folder, **options).mapInArrow(_describe, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
