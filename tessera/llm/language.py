"""Language identification by a string kernel.

Kernel: k(s, t) is the number of n-grams of 1 to ORDER bytes (A-Z in lower case) that both texts hold, a presence kernel of the blended
spectrum, over the model's n-grams and divided by the root of k(s, s) * k(t, t). Nystroem: LANDMARKS texts stand for the feature
space; a text's features are its kernel values with them times K^(-1/2), where K is the landmarks' own kernel matrix. Classifier:
kernel ridge regression of +1 and -1, one language against the rest, solved from sums over the fit sample's features with rows
weighted so that languages count alike. Scoring: a batch of whole texts is a matrix of presence bits; it is multiplied by
the landmarks' bits and then by the weights.

Fit: on about FIT_ROWS labelled documents of each language (drawn by a hash of the id), a bound of the fit only; every
text is scored, whole. The model's n-grams are the VOCABULARY most widespread of the fit sample, those in one document left out.
Documents with crc32(doc_id as text) % 4 = 2 are held out: nothing is learned from them.

Defined cases: null texts and texts without a letter are `und` with score 0, as are all texts if nothing could be learned; a null id is not
held out and nothing is learned from it; a null lang is no label; a text that holds none of the n-grams gets the language of the
greatest bias; ties go to the smaller language name; rows that repeat an id stay, each with its own result; an empty table gives no rows.
score: half the difference of the best two outputs, between 0 and 1 (one learned language: against -1).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER, LANDMARKS, FIT_ROWS, VOCABULARY, RIDGE, HELD_OUT = 3, 128, 1_000, 16_384, 1e-3, 2
#: Bytes of a text that are turned into n-grams at a time, and texts of one matrix.
PIECE, TEXTS = 1 << 20, 64
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(data: np.ndarray, inner: np.ndarray):
    """For each n: the positions whose n bytes lie in one text, and the n-grams there as numbers, n in the top byte. inner: bytes left in the text from each position."""
    data = _LOWER[data].astype(np.int64)
    key = np.zeros(len(data), np.int64)
    for n in range(1, ORDER + 1):
        key = (key[: len(data) - n + 1] << 8) | data[n - 1 :]
        at = np.flatnonzero(inner[: len(key)] >= n)
        yield n, at, key[at]


def _pieces(offs: np.ndarray):
    """(first text, end text, start, end): runs of at most TEXTS whole texts and PIECE bytes; a longer text in pieces that overlap by ORDER - 1 bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = i + 1
        if offs[j] - offs[i] > PIECE:
            for start in range(offs[i], offs[j], PIECE):
                yield i, j, start, min(start + PIECE + ORDER - 1, int(offs[j]))
        else:
            while j < n and j - i < TEXTS and offs[j + 1] - offs[i] <= PIECE:
                j += 1
            yield i, j, int(offs[i]), int(offs[j])
        i = j


def _held(batches):
    """doc_id, lang, text -> (doc_id, lang, gram): the distinct n-grams of each text."""
    for batch in batches:
        for first, data, offs in C.chunks(batch.column("text")):
            rows = []
            for k in range(len(offs) - 1):
                text = data[offs[k] : offs[k + 1]]
                seen = [np.zeros(0, np.int64)]
                for start in range(0, len(text), PIECE):
                    part = text[start : start + PIECE + ORDER - 1]
                    seen += [np.unique(key) | n << 40 for n, _, key in _grams(part, len(part) - np.arange(len(part)))]
                rows.append(np.unique(np.concatenate(seen)))
            per = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            at = slice(first, first + len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(c)[at] for c in ("doc_id", "lang")] + [C.lists(np.concatenate(rows), per, pa.int64())], ["doc_id", "lang", "grams"])


class Model:
    """The fitted kernel machine: n-grams, landmarks' bits, and weights from kernel values to languages. Its size is bounded by the parameters."""

    def __init__(self, grams: np.ndarray, landmarks: np.ndarray):
        self.grams, self.landmarks = grams, landmarks.astype(np.float32)
        norm = np.sqrt(np.maximum(landmarks.sum(1), 1))
        self.norms = norm
        k = landmarks.astype(np.float64) @ landmarks.T / np.outer(norm, norm)
        values, vectors = np.linalg.eigh(k)
        good = values > 1e-6 * max(values.max(), 1e-12)
        self.root = vectors[:, good] / np.sqrt(values[good])
        self.weights, self.languages = np.zeros((self.root.shape[1] + 1, 0)), []
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "landmarks": (np.packbits(self.landmarks > 0, axis=1), self.landmarks.shape[1])}

    def __setstate__(self, state):
        bits, width = state["landmarks"]
        self.__dict__ |= state | {"landmarks": np.unpackbits(bits, axis=1, count=width).astype(np.float32)}

    def _lookup(self, n: int, key: np.ndarray) -> np.ndarray:
        """Column of each n-gram; the last, which counts for nothing, if it isn't the model's. Direct tables, built once for each process."""
        if self._tables is None:
            spare = len(self.grams)
            self._tables = {}
            for size in range(1, ORDER + 1):
                own = np.flatnonzero(self.grams >> 40 == size)
                # Only bytes that occur get a place, so the tables stay small.
                used = np.zeros(256, np.int64)
                found = np.unique([(self.grams[own] & (1 << 40) - 1) >> 8 * b & 255 for b in range(size)]) if len(own) else np.zeros(0, np.int64)
                used[found.astype(np.int64)] = np.arange(1, len(found) + 1)
                base = len(found) + 1
                table = np.full(base**size, spare, np.int32)
                table[self._place(self.grams[own] & (1 << 40) - 1, size, used, base)] = own
                self._tables[size] = (table, used, base)
        table, used, base = self._tables[n]
        return table[self._place(key, n, used, base)]

    @staticmethod
    def _place(key: np.ndarray, n: int, used: np.ndarray, base: int) -> np.ndarray:
        at = np.zeros(len(key), np.int64)
        for b in range(n - 1, -1, -1):
            at = at * base + used[key >> 8 * b & 255]
        return at

    def presence(self, data: np.ndarray, offs: np.ndarray):
        """(first text, end text, bits of float32): whole texts; pieces of one long text are one row."""
        bits, before = None, -1
        for i, j, start, end in _pieces(offs):
            if i != before:
                if bits is not None:
                    yield before, before + len(bits), bits[:, :-1]
                bits, before = np.zeros((j - i, len(self.grams) + 1), np.float32), i
            ends = np.repeat(offs[i + 1 : j + 1], np.diff(np.clip(offs[i : j + 1], start, end)))
            row = np.repeat(np.arange(j - i), np.diff(np.clip(offs[i : j + 1], start, end)))
            for n, at, key in _grams(data[start:end], ends - np.arange(start, end)):
                bits[row[at], self._lookup(n, key)] = 1
        if bits is not None:
            yield before, before + len(bits), bits[:, :-1]

    def features(self, bits: np.ndarray) -> np.ndarray:
        shared = (bits @ self.landmarks.T).astype(np.float64)
        kernel = shared / self.norms / np.sqrt(np.maximum(bits.sum(1), 1))[:, None]
        return np.concatenate([kernel @ self.root, np.ones((len(bits), 1))], 1)

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.languages)))
        for first, data, offs in C.chunks(column):
            for i, j, bits in self.presence(data, offs):
                out[first + i : first + j] = self.features(bits) @ self.weights
        return out


def _sums(model: Model, languages: list[str], weights: dict[str, float]):
    """text, lang -> (i, j, value): a task's sums of features by features and, from column d on, of features by targets."""

    def run(batches):
        d = model.root.shape[1] + 1
        total = np.zeros((d, d + len(languages)))
        place = {x: k for k, x in enumerate(languages)}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for first, data, offs in C.chunks(batch.column("text")):
                for i, j, bits in model.presence(data, offs):
                    own = [place[x] for x in langs[first + i : first + j]]
                    w = np.array([weights[languages[k]] for k in own])[:, None]
                    x = model.features(bits)
                    y = np.where(np.arange(len(languages)) == np.array(own)[:, None], 1.0, -1.0)
                    total += (x * w).T @ np.concatenate([x, y], 1)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "value"])

    return run


def fit(docs: DataFrame, landmarks: int = LANDMARKS, rows: int = FIT_ROWS, vocabulary: int = VOCABULARY, ridge: float = RIDGE) -> Model | None:
    """The model of labelled documents (doc_id, text, lang); None if there are none. Bounded: about `rows` documents of each language."""
    known = docs.where("lang is not null and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != HELD_OUT)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows / counts[k]))])
    sample = C.written(known.withColumn("draw", draw).where(F.col("draw") < shares[F.col("lang")]).where("text is not null").select("doc_id", "lang", "text", "draw"))
    held = C.written(sample.select("doc_id", "lang", "text").mapInArrow(C.trimmed(_held), "doc_id long, lang string, grams array<long>"))
    spread = held.select(F.explode("grams").alias("gram")).groupBy("gram").count().where("count > 1").orderBy(F.desc("count"), "gram").limit(vocabulary)
    marks = C.written(spread.select("gram"))
    grams = np.sort(np.array([r["gram"] for r in marks.collect()], np.int64))
    # The landmarks: of each language as many, the first in the order of the draw.
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not sizes or not len(grams):
        return None
    languages = sorted(sizes)
    each = max(1, landmarks // len(languages))
    few = sample.where(F.col("draw") < F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 4.0 * (each + 8) / counts[k]))])[F.col("lang")])
    chosen = [r for k in languages for r in few.where(F.col("lang") == k).select("doc_id", "draw").orderBy("draw", "doc_id").limit(each).collect()]
    ids = sorted({r["doc_id"] for r in chosen})
    own = held.where(F.col("doc_id").isin(ids)).select("doc_id", F.explode("grams").alias("gram")).join(marks, "gram", "left_semi").groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))
    bits = np.zeros((len(ids), len(grams)), bool)
    for r in own.collect():  # bounded: landmarks times n-grams
        bits[ids.index(r["doc_id"]), np.searchsorted(grams, np.array(r["grams"], np.int64))] = True
    model = Model(grams, bits[bits.any(1)] if bits.any() else bits)
    weights = {k: 1.0 / sizes[k] for k in languages}
    made = sample.select("lang", "text").mapInArrow(C.trimmed(_sums(model, languages, weights)), "i long, j long, value double")
    d = model.root.shape[1] + 1
    total = np.zeros((d, d + len(languages)))
    for r in made.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # bounded: features by features
        total[r["i"], r["j"]] = r["value"]
    model.languages = languages
    model.weights = np.linalg.solve(total[:, :d] + ridge * np.eye(d), total[:, d:])
    C.tidy(sample, held, marks)
    return model


def _predict(model: Model):
    def run(batches):
        for batch in batches:
            out = model.scores(batch.column("text"))
            best = out.argmax(1) if len(out) else np.zeros(0, np.int64)
            first = out[np.arange(len(out)), best]
            rest = np.where(np.arange(out.shape[1]) == best[:, None], -np.inf, out).max(1) if out.shape[1] > 1 else np.full(len(out), -1.0)
            score = np.clip((first - rest) / 2, 0, 1).round(6)
            named = pa.array([model.languages[k] for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "held_out", "worded")] + [named, pa.array(score)], ["doc_id", "held_out", "worded", "lang", "score"])

    return run


def identified(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document of docs (doc_id, text, lang). options: those of fit()."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("worded"), "text")
    model = fit(docs.select("doc_id", "text", "lang"), **options)
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.mapInArrow(C.trimmed(_predict(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, worded boolean, lang string, score double")
    return found.select("doc_id", "held_out", F.when(F.col("worded"), F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("worded"), F.col("score")).otherwise(0.0).alias("score"))
