"""Packing along a space-filling curve.

A document's hashed words give a vector of DIMS signed sums; each is scaled to a unit normal and quantised by the
normal distribution function, and the Hilbert index of the cell (with a hash of doc_id below it, so equal texts
spread evenly) orders the documents. Rows are dealt by ranges of that key, sorted, and laid end to end: each range
fills sequences of `length` ids, so neighbours on the curve share sequences. What is left at the end of a range is
cut into sequences of powers of two, which need no padding. The range bounds come from a sample of at most
BOUND_SAMPLE documents; they only balance the ranges.

A document is tokenised once: its white-space-separated words are looked up by hash in a table of words seen by the
worker (at most CACHE words, then started anew), and only new words go to the tokenizer. The table's keys are of A-Z-lowered
words, which is right for a tokenizer that lower-cases; one that doesn't is refused. Words with "<|", which may be added
tokens and are matched as they are spelled, go by their bytes.

Defined cases: null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed each;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, END, DIMS, BITS, BOUND_SAMPLE, CACHE = 2048, 1, 4, 8, 50_000, 1_200_000
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text in one range of the curve, at most about; there are spark.sql.shuffle.partitions ranges at least.
RANGE_BYTES = 256 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of integer points (n, dims): undo the excess rotations from the top bit down, Gray-decode, interleave."""
    x = axes.astype(np.uint64).T.copy()
    dims = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > 1:
        p = q - one
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


_NORMAL = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in np.linspace(-4, 4, 801)])


def curve_keys(hashes: np.ndarray, per: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """63-bit keys: Hilbert index of the hashed word vector, then 31 bits of the id's hash."""
    counts = np.maximum(np.diff(per), 1)
    cells = np.empty((len(per) - 1, DIMS), np.int64)
    for k in range(DIMS):
        total = np.concatenate([[0], np.cumsum(((hashes >> np.uint64(7 * k + 3)) & np.uint64(1)).astype(np.int64) * 2 - 1)])
        z = (total[per[1:]] - total[per[:-1]]) / np.sqrt(counts)
        cells[:, k] = np.minimum((np.interp(z, np.linspace(-4, 4, 801), _NORMAL) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return (hilbert(cells, BITS) << np.uint64(31) | (C.mix(ids.astype(np.uint64)) >> np.uint64(33))).astype(np.int64)


class Words:
    """Hash-indexed token ids of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.sep = self.tok.token_to_id("<|startoftext|>")
        low, high = (self.tok.encode(x, add_special_tokens=False).ids for x in ("the quick az", "THE Quick AZ"))
        if low != high:
            raise ValueError("the tokenizer tells upper from lower case")
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    @staticmethod
    def _raw(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Words that may hold added tokens, which are matched before lower-casing, go by their own bytes."""
        marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        if not len(marks):
            return hashes
        hashes = hashes.copy()
        for i in np.unique(np.searchsorted(starts, marks, "right") - 1):
            hashes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=1)
        return hashes

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids: list[list[int]] = [[] for _ in words]
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        for i in set(range(len(words))) - set(plain):
            ids[i] = self.tok.encode(words[i], add_special_tokens=False).ids
        for lo in range(0, len(plain), 256):
            some = plain[lo : lo + 256]
            got = self.tok.encode_batch_fast(["<|startoftext|>".join(words[i] for i in some)], add_special_tokens=False)[0].ids
            got = np.array(got + [self.sep])
            cuts = np.flatnonzero(got == self.sep)
            if len(cuts) != len(some):
                raise ValueError("the tokenizer did not keep words apart")
            a = 0
            for i, b in zip(some, cuts.tolist()):
                ids[i] = got[a:b]
                a = b + 1
        n = np.array([len(x) for x in ids], np.int64)
        at = len(self.pool) + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        self.pool = np.concatenate([self.pool, *[np.asarray(x, np.uint16) for x in ids]])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.n = keys[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in order, and their offsets per text."""
        if not len(hashes):
            return np.zeros(0, np.uint16), np.zeros(len(per), np.int64)
        hashes = self._raw(data, starts, ends, hashes)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHE:
            self.clear()
        spot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool) if not len(self.keys) else self.keys[np.minimum(spot, len(self.keys) - 1)] == unique
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            self.learn(unique[new], [raw[starts[i] : ends[i]].decode() for i in first[new]])
            spot = np.searchsorted(self.keys, unique)
        n = self.n[spot][back]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.pool[np.arange(total[-1]) + np.repeat(self.at[spot][back] - total[:-1], n)]
        return out, total[per]


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The worker's table, kept from task to task."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _encode(path: str, bounds: np.ndarray, slots: list[int], end: int):
    def run(batches):
        words = words_of(path)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, data, offs in C.chunks(batch.column("text"), 2 << 20):
                starts, ends, hashes, per = C.words(data, offs)
                tokens, cuts = words.encode(data, starts, ends, hashes, per)
                part = ids.slice(lo, len(offs) - 1)
                keys = curve_keys(hashes, per, np.asarray(part.fill_null(-1)))
                tokens = np.insert(tokens, cuts[1:], np.uint16(end)) if len(cuts) > 1 else tokens
                cuts = (cuts + np.arange(len(cuts))) * 2
                blob = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(tokens.astype("<u2"))]).cast(pa.binary())
                slot = np.asarray(slots)[np.searchsorted(bounds, keys, "right")]
                yield pa.RecordBatch.from_arrays([part, pa.array(slot, pa.int64()), pa.array(keys), blob], ["doc_id", "slot", "key", "tokens"])

    return run


def _cut(length: int, with_ids: bool):
    def run(batches):
        base, sequence = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []
        open_: list[tuple] = []
        fill = 0

        def close(pieces):
            nonlocal sequence
            offset = 0
            for doc, start, ids, n in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), n, base + sequence, offset, raw if with_ids else None))
                offset += len(ids)
            sequence += 1

        def batch_of():
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7 + with_ids)], names[: 7 + with_ids])
            rows.clear()
            return out

        for batch in batches:
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("tokens")):
                ids = np.frombuffer(blob.as_buffer(), "<u2")
                at = 0
                while at < len(ids):
                    n = min(length - fill, len(ids) - at)
                    open_.append((doc, at, ids[at : at + n], len(ids)))
                    at, fill = at + n, fill + n
                    if fill == length:
                        close(open_)
                        open_, fill = [], 0
                    if len(rows) >= 20_000:
                        yield batch_of()
        while fill:
            size = 1 << (fill.bit_length() - 1)
            head, left = [], size
            while left:
                doc, start, ids, n = open_.pop(0)
                head.append((doc, start, ids[:left], n))
                if len(ids) > left:
                    open_.insert(0, (doc, start + left, ids[left:], n))
                left -= min(left, len(ids))
            close(head)
            fill -= size
        yield batch_of()

    return run


def _keys(batches):
    for batch in batches:
        for lo, data, offs in C.chunks(batch.column("text"), 2 << 20):
            _, _, hashes, per = C.words(data, offs)
            keys = curve_keys(hashes, per, np.asarray(batch.column("doc_id").slice(lo, len(offs) - 1).fill_null(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])


def slots_for(spark, n: int) -> list[int]:
    """n numbers that hash-partitioning by n deals to partitions 0 to n-1: an exact deal without a sampling pass."""
    found: dict[int, int] = {}
    top = 16
    while len(found) < n:
        top *= 4
        rows = spark.range(n * top).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
        found = {r["p"]: r["id"] for r in rows}
    return [found[i] for i in range(n)]


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids (little-endian uint32)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // RANGE_BYTES))
    some = docs if rows <= BOUND_SAMPLE else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * BOUND_SAMPLE / rows))
    keys = some.mapInArrow(_keys, "key long").toDF("key")
    bounds = keys.select(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bounds = np.array(bounds or [], np.int64)[: n - 1]
    coded = docs.mapInArrow(_encode(path or tokenizer_path(), bounds, slots_for(spark, n), end), "doc_id long, slot long, key long, tokens binary")
    dealt = coded.repartition(n, "slot").sortWithinPartitions("slot", "key", "doc_id", F.xxhash64("tokens"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return dealt.mapInArrow(_cut(length, with_ids), schema)
