"""Quality classifier: document evidence combined with host and path posteriors (hierarchical empirical Bayes).

1. A logistic model over whole-text statistics is fitted on at most FIT_ROWS labelled documents (those of the
   smallest id hashes; a documented bound, independent of the corpus size).
2. Every document gets p = P(good | its text). Grouped aggregation gives sums of p per host (source) and per path
   (source, lang), with partial aggregation before the shuffle, so a hot host costs one row per task.
3. Hosts shrink toward the corpus mean with strength k1, paths toward their host with strength k2, both by the method
   of moments over all groups: posterior mean = (sum + k * parent) / (n + k). Sparse sites stay near their parent.
4. A document's log-odds are its own evidence plus WEIGHT times the path's log-odds relative to the corpus. The document
   itself is left out of its path and its host there. It is kept at a posterior of THRESHOLD or more.

Defined cases: a null text counts as empty; empty texts have no evidence of their own and follow their site; null
sources and languages are groups of their own; without labels of both classes the model is constant and all stay;
repeated rows count each; labels given twice or with nulls: the largest label of an id, nulls ignored. Columns
beyond those named are untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

FIT_ROWS, WEIGHT, THRESHOLD = 20_000, 0.5, 0.5
FEATURES = ["upper", "digit", "symbol", "bar", "bang", "stop", "newline", "word_length", "distinct_words", "repeated_shingles", "size"]

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"#$%&*@^~=+<>\\/_{}[]`")] = 3
_CLASS[ord("|")] = 4
_CLASS[ord("!")] = 5
_CLASS[list(b".,;:?")] = 6
_CLASS[10] = 7


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8)
    starts, ends, hashes, per = C.words(data, offs)
    words = np.diff(per)
    out[:, :7] = counts[:, 1:] / np.maximum(size, 1)[:, None]
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    out[:, 7] = (length[per[1:]] - length[per[:-1]]) / np.maximum(words, 1) / 10
    sh, at = C.shingles(hashes, per)
    for values, cuts, column, sign in ((hashes, per, 8, 0), (sh, at, 9, 1)):
        owner = np.repeat(np.arange(n), np.diff(cuts))
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        fresh = np.ones(len(v), bool)
        fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        share = np.bincount(o[fresh], minlength=n) / np.maximum(np.diff(cuts), 1)
        out[:, column] = 1 - share if sign else share / np.log2(np.maximum(np.diff(cuts), 1) + 2)
    out[:, 10] = np.log1p(words) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> dict | None:
    """Ridge logistic regression by Newton steps with halving; None without both classes."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * len(y) * np.r_[0, np.ones(x.shape[1])]

    def loss(w):
        m = z @ w
        return np.logaddexp(0, m).sum() - (y * m).sum() + 0.5 * (penalty * w * w).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6), z.T @ (y - p) - penalty * w)
        t = 1.0
        while loss(w + t * step) > loss(w) and t > 1e-4:
            t /= 2
        w = w + t * step
        if np.abs(t * step).max() < 1e-7:
            break
    return {"w": w, "mean": mean, "scale": scale}


def logit(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 35.0)
    return np.clip(model["w"][0] + ((x - model["mean"]) / model["scale"]) @ model["w"][1:], -35, 35)


def _features(batches):
    for batch in batches:
        found = [features(data, offs) for _, data, offs in C.chunks(batch.column("text"))]
        if found:
            x = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict | None:
    """The model from at most `rows` labelled documents, by the smallest hash of doc_id."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    labels = labels.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows).select("doc_id", "quality")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels), "doc_id").mapInArrow(C.trimmed(_features), "doc_id long, quality double, x array<double>").groupBy("doc_id").agg(F.max(F.struct("quality", "x")).alias("r")).select("doc_id", "r.*").toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(np.asarray(found.column("doc_id")), kind="stable")
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))[order]
    return fit(x, np.asarray(found.column("quality"))[order])


def _score(model, text: str):
    def run(batches):
        for batch in batches:
            found = [np.zeros(0)]
            for _, data, offs in C.chunks(batch.column(text)):
                score = logit(model, features(data, offs))
                found.append(np.where(np.diff(offs) == 0, 0.0, score) if model else score)
            yield batch.select([c for c in batch.schema.names if c != text]).append_column("evidence", pa.array(np.concatenate(found)))

    return run


def evidence(docs: DataFrame, model: dict | None, text: str) -> DataFrame:
    """docs with `evidence`, the model's log-odds for the whole text, in place of the text column."""
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text), T.StructField("evidence", T.DoubleType())])
    return docs.mapInArrow(C.trimmed(_score(model, text)), schema)


def _strength(groups: DataFrame, mean: str) -> float:
    """Method of moments for (n, s) groups: prior strength from the spread of the group means beyond their sampling error."""
    m = F.col("s") / F.col("n")
    row = groups.agg(F.sum(F.col("n") * (m - F.col(mean)) ** 2), F.sum(F.col(mean) * (1 - F.col(mean))), F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))), F.count("*")).first()
    if not row[3] or not row[2]:
        return 1.0
    between = max((row[0] - row[1]) / row[2], 1e-4)  # share of the variance that lies between groups
    return float(min(max(1 / between - 1, 1.0), 1e4))


def sites(scored: DataFrame) -> tuple[DataFrame, float]:
    """(source_key, lang_key, n, s, host_n, host_s, host, path, k1, k2: sums, posteriors, strengths), and the corpus mean, of rows with `p`."""
    path = C.written(scored.groupBy("source_key", "lang_key").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    total = path.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max(total[1] / total[0], 1e-6), 1 - 1e-6) if total[0] else 0.5
    host = path.groupBy("source_key").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("up", F.lit(mean))
    k1 = _strength(host, "up")
    host = C.written(host.select("source_key", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + k1 * mean) / (F.col("n") + k1)).alias("host")))
    both = C.written(path.join(host, "source_key"))
    k2 = _strength(both, "host")
    return both.withColumns({"k1": F.lit(k1), "k2": F.lit(k2), "path": (F.col("s") + k2 * F.col("host")) / (F.col("n") + k2)}), mean


def classify(docs: DataFrame, labels: DataFrame, weight: float = WEIGHT, threshold: float = THRESHOLD, rows: int = FIT_ROWS, columns: list[str] | None = None) -> DataFrame:
    """docs' columns (or those asked) and evidence, document_p, host_p, path_p, posterior, keep; input columns of these names are replaced."""
    docs = docs.drop("evidence", "document_p", "host_p", "path_p", "posterior", "keep")
    columns = [c for c in (columns or docs.columns) if c in docs.columns]
    model = train(docs, labels, rows)
    keys = {"source_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "lang_key": F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n"))}
    # Texts are read for evidence once; only what is returned is written beside it.
    keyed = docs.select(*columns, *[F.col("text").alias("_tessera_text")], *[c.alias(f"_tessera_{k}") for k, c in keys.items()])
    scored = C.written(evidence(keyed, model, "_tessera_text").withColumn("document_p", 1 / (1 + F.exp(-F.col("evidence")))))
    groups, mean = sites(scored.select(*[F.col(f"_tessera_{k}").alias(k) for k in keys], F.col("document_p").alias("p")))
    groups = groups.toDF(*[f"_tessera_{c}" for c in groups.columns])
    out = C.join_checked(scored, groups, ["_tessera_source_key", "_tessera_lang_key"], "inner")
    col = lambda c: F.col(f"_tessera_{c}")
    own = F.col("document_p")
    host = (col("host_s") - own + col("k1") * mean) / (col("host_n") - 1 + col("k1"))
    rest = (col("s") - own + col("k2") * host) / (col("n") - 1 + col("k2"))
    rest = F.least(F.greatest(rest, F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("evidence") + weight * (F.log(rest / (1 - rest)) - float(np.log(mean / (1 - mean))))
    out = out.withColumns({"host_p": col("host"), "path_p": col("path"), "posterior": 1 / (1 + F.exp(-odds))}).withColumn("keep", F.col("posterior") >= threshold)
    return out.select(*columns, "evidence", "document_p", "host_p", "path_p", "posterior", "keep")
