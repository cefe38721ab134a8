"""Substring dedup by compact windows.

Every position of a text carries the hash of the 5-word shingle there. For each of HASHES hash functions, the
subsequences of at least SPAN shingles that share a minimum form compact windows: the minimum's position, and how far
left and right it stays the minimum, as in the text's Cartesian tree. About 2 n / SPAN windows of n positions have room
for such a subsequence; only they are built. Windows meet by signature (the minimum's value): every one meets the
first window of its value, in the order of doc_id and position, so a passage that thousands share makes stars, not
pairs.

An interval join follows: met windows of a pair of documents are grouped where they overlap on one diagonal, and
such regions are joined where they overlap in both texts on diagonals that inserted or deleted words can put apart.
Regions in which enough hashes agree are verified on the words themselves. Verified is an exact common run of MIN_WORDS
words or more, or a region of so many words in both texts whose shingle sets have a Jaccard similarity of 0.8.

The first window of a value may hold only a part of what two later ones share, or be met by one hash only. So another meeting follows for
exact passages, but for values at one place each of two documents that have been compared. Of a run of SPAN shingles, half stand on one side of its minimum by the first hash. Windows of that hash whose half on
one side, taken exactly, is another document's too, and which verified passages don't cover, yield every run of SPAN shingles
around their minimum, keyed by the run's own hash, and those not covered meet the first run of their key. An exact passage of SPAN + 4
words or more gives the same minimum and the same runs in every text, so none is missed. For near copies only the meetings of windows
are made: one whose equal parts all stand in earlier documents, none of which holds the whole, can be missed. The
first occurrence stays; the passages found in later documents are cut.

Defined cases: null, empty and short texts have no windows; rows with a null doc_id take no part; repeats within one
document are left; rows that repeat a doc_id and its text are one document, rows of one doc_id with different texts are
several (the one of the least text hash in the place of its doc_id, the others after all documents), told apart by text_key;
an empty table gives no rows. Texts are read
whole; other columns are kept as they are by `cut`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SHINGLE, SPAN, HASHES, ENOUGH, MIN_WORDS, SIMILARITY = 5, 46, 4, 2, 50, 0.8
_SEEDS = C.mix(np.arange(501, 501 + HASHES, dtype=np.uint64))
_MASK, _FAR = (1 << 48) - 1, (1 << 15) - 1


def window_minima(keys: np.ndarray, per: np.ndarray, span: int) -> np.ndarray:
    """Positions that are the minimum of a run of `span` positions inside one text (leftmost of ties), ascending."""
    n = len(keys)
    starts = [np.arange(a, b - span + 1) for a, b in zip(per[:-1], per[1:]) if b - a >= span]
    if not starts:
        return np.zeros(0, np.int64)
    starts = np.concatenate(starts)
    room = max(18, int(n).bit_length())
    low = np.uint64((1 << room) - 1)
    packed = (keys & ~low) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    grid = padded.reshape(-1, span)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[starts], head[starts + span - 1]) & low
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    return np.unique(least[fresh]).astype(np.int64)


def extents(keys: np.ndarray, spots: np.ndarray, begin: int, end: int) -> tuple[list[int], list[int]]:
    """For minima at `spots` of one text: first and last position of the stretch in which each is the minimum.

    The nearest smaller keys on both sides of a window's minimum are minima of windows themselves, so a stack over
    the spots alone gives the Cartesian tree's ranges.
    """
    left, right, stack = [begin] * len(spots), [end - 1] * len(spots), []
    values = keys[spots].tolist()
    where = spots.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = where[i] - 1
        if stack:
            left[i] = where[stack[-1]] + 1
        stack.append(i)
    return left, right


_WINDOWS = "doc_id long, windows array<struct<v:long,at:long,reach:long,more:array<struct<at:long,reach:long>>>>"


def _side(span: int) -> int:
    """Of a run of `span` shingles, so many at least stand on one side of its minimum, which counts."""
    return (span + 2) // 2


def _contexts(values: np.ndarray, spots: np.ndarray, begin: np.ndarray, end: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes of the `side` shingles that end, and that begin, at each spot; 0 where the text hasn't so many."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(values))])

    def marks(lo, hi):
        good = (lo >= begin) & (hi <= end)
        out = (C.mix(total[np.where(good, hi, 0)] - total[np.where(good, lo, 0)]) >> np.uint64(48)).astype(np.int64)
        return np.where(good, np.maximum(out, 1), 0)

    return marks(spots - side + 1, spots + 1), marks(spots, spots + side)


def _windows(span: int):
    """Of a value's places in one text, the first is the row; of the first hash, `more` has the others (a position and reach each).

    at: hash number << 48 | position; reach: left << 48 | right extent around it << 32 | left context << 16 | right context.
    """

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            ids = batch.column("doc_id")
            for lo, data, offs in C.chunks(column):
                _, _, hashes, words_per = C.words(data, offs)
                values, per = C.shingles(hashes, words_per, SHINGLE)
                rows: list[list] = [[], [], [], [], []]  # text, v, at, reach, number of further places
                places = []
                for h, seed in enumerate(_SEEDS):
                    keys = C.mix(values ^ seed)
                    spots = window_minima(keys, per, span)
                    if not len(spots):
                        continue
                    doc = np.searchsorted(per, spots, "right") - 1
                    cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
                    left, right = np.empty(len(spots), np.int64), np.empty(len(spots), np.int64)
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        left[a:b], right[a:b] = extents(keys, spots[a:b], per[doc[a]], per[doc[a] + 1])
                    before, after = _contexts(values, spots, per[doc], per[doc + 1], _side(span)) if h == 0 else (0, 0)
                    reach = np.minimum(spots - left, _FAR) << 48 | np.minimum(right - spots, _FAR) << 32 | before << 16 | after
                    held, at = keys[spots], (h << 48) | (spots - per[doc])
                    order = np.lexsort((spots, held, doc))
                    fresh = np.r_[True, (held[order][1:] != held[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
                    once, again = order[fresh], order[~fresh]
                    more = np.diff(np.r_[np.flatnonzero(fresh), len(order)]) - 1
                    for column_, x in zip(rows, (doc[once], C.signed(held[once]), at[once], reach[once], more if h == 0 else np.zeros(len(once), np.int64))):
                        column_.append(x)
                    if h == 0:
                        places = [at[again], reach[again]]
                if not places:
                    continue
                doc, vs, ats, reaches, more = (np.concatenate(x) for x in rows)
                order = np.argsort(doc, kind="stable")
                further = pa.StructArray.from_arrays([pa.array(x) for x in places], ["at", "reach"])
                further = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(more)]).astype(np.int32)), further)
                struct = pa.StructArray.from_arrays([*(pa.array(x[order]) for x in (vs, ats, reaches)), further.take(pa.array(order))], ["v", "at", "reach", "more"])
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offs) - 1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(offs) - 1), pa.ListArray.from_arrays(pa.array(cuts), struct)], ["doc_id", "windows"])

    return run


def _words32(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, data, offs in C.chunks(batch.column("text")):
            _, _, hashes, per = C.words(data, offs)
            small = (hashes >> np.uint64(32)).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(offs) - 1), pa.array([small[4 * a : 4 * b] for a, b in zip(per[:-1], per[1:])], pa.binary())], ["doc_id", "words"])


def _runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, equal.astype(np.int8), 0]))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def _shingles(w: np.ndarray) -> np.ndarray:
    if len(w) < SHINGLE:
        return np.zeros(0, np.uint64)
    w = w.astype(np.uint64)
    return sum(C.mix(w[j : len(w) - SHINGLE + 1 + j] + np.uint64(j << 33)) for j in range(SHINGLE))


def _set_similarity(x: np.ndarray, y: np.ndarray) -> float:
    a, b = np.unique(_shingles(x)), np.unique(_shingles(y))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def matched(x: np.ndarray, x0: int, y: np.ndarray, y0: int, met: tuple, enough: int, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Verified passages (start, end, first start, hashes, similarity) of texts x and y, given as words from x0 and y0 on.

    met: arrays (at, reach, first, first reach) of windows that share a minimum. They are joined as intervals: those of one diagonal that
    overlap form a region. Exact runs in it count as they are; a near copy must be supported by `enough` different hashes.
    """
    at, reach, first, first_reach = met
    number, at, first = at >> 48, at & _MASK, first & _MASK
    low = at - np.minimum(reach >> 48, first_reach >> 48)
    high = at + np.minimum((reach >> 32) & _FAR, (first_reach >> 32) & _FAR)
    diagonal = at - first
    order = np.lexsort((high, low, diagonal))
    pieces: list[tuple] = []
    for lo, hi, d, h in zip(low[order].tolist(), high[order].tolist(), diagonal[order].tolist(), number[order].tolist()):
        if pieces and pieces[-1][2] == d and lo <= pieces[-1][1]:
            last = pieces[-1]
            pieces[-1] = (last[0], max(last[1], hi), d, last[3] | {h})
        else:
            pieces.append((lo, hi, d, {h}))
    several = len(pieces) > 1 and pieces[0][2] != pieces[-1][2]
    pieces.sort(key=lambda p: p[:3])
    joined = _across(x, x0, y, y0, pieces, enough, min_words, similarity) if several else []
    out = [p for p, _ in joined]
    done = {i for _, chain in joined for i in chain}
    for i, (lo, hi, d, hashes) in enumerate(pieces):
        if i in done:
            continue
        a, b = x[lo - x0 : hi + SHINGLE - x0], y[lo - d - y0 : hi + SHINGLE - d - y0]
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        equal = a == b
        runs = _runs(equal, min_words)
        solid = _runs(equal, SHINGLE) if len(hashes) >= enough else []
        if solid:
            p, q = solid[0][0], solid[-1][1]
            if q - p >= min_words and not (len(runs) == 1 and runs[0] == (p, q)):
                alike = _set_similarity(a[p:q], b[p:q])
                if alike >= similarity:
                    out.append((lo + p, lo + q, lo + p - d, len(hashes), alike))
                    continue
        out += [(lo + p, lo + q, lo + p - d, len(hashes), 1.0) for p, q in runs]
    return out


def _across(x: np.ndarray, x0: int, y: np.ndarray, y0: int, pieces: list[tuple], enough: int, min_words: int, similarity: float) -> list[tuple]:
    """Passages over several diagonals, each with the indices of its pieces (lo, hi, diagonal, hashes; sorted).

    Pieces join while they overlap or touch in both texts. Words put in between shift the diagonal and are shingles of one
    text only, so at a Jaccard similarity of s the shift is at most (1 - s) / s of the length.
    """
    solid = []
    for lo, hi, diagonal, _ in pieces:
        a, b = x[lo - x0 : hi + SHINGLE - x0], y[lo - diagonal - y0 : hi + SHINGLE - diagonal - y0]
        n = min(len(a), len(b))
        runs = _runs(a[:n] == b[:n], SHINGLE)
        solid.append((lo + runs[0][0], lo + runs[-1][1]) if runs else None)
    # A passage's part of y lies between the first and last solid place there, so its part of x is bounded too.
    inside = [(r[0] - p[2], r[1] - p[2]) for r, p in zip(solid, pieces) if r]
    room = (max(e for _, e in inside) - min(s for s, _ in inside)) / similarity if inside else 0
    # Of x, the shingles that y doesn't have, each where it stands first: so many at least are in no passage's intersection.
    own = _shingles(x)
    lone = np.zeros(len(own), np.int64)
    lone[np.unique(own, return_index=True)[1]] = 1
    lone[np.isin(own, _shingles(y))] = 0
    lone = np.concatenate([[0], np.cumsum(lone)])
    out, i = [], 0
    while i < len(pieces):
        best, chain, tried = None, [], []
        top_x = top_y = several = 0
        start = end = None  # (solid place, diagonal) of the chain's first and last solid word
        hashes: set[int] = set()
        for j in range(i, len(pieces)):
            lo, hi, diagonal, seen = pieces[j]
            if chain and (lo > top_x + SHINGLE or lo - start[0] > room):
                break
            if solid[j] is None or (chain and lo - diagonal > top_y + SHINGLE):
                continue
            if not chain:
                top_x, top_y = hi, hi - diagonal
            several += bool(chain) and diagonal != pieces[chain[0]][2]
            top_x, top_y = max(top_x, hi), max(top_y, hi - diagonal)
            start = min(start or (solid[j][0], diagonal), (solid[j][0], diagonal))
            end = max(end or (solid[j][1], diagonal), (solid[j][1], diagonal))
            hashes |= seen
            chain.append(j)
            (p, d), (q, e) = start, end
            size, other = q - p, (q - e) - (p - d)
            if not several or d == e or len(hashes) < enough or min(size, other) < min_words or abs(size - other) > min(size, other) * (1 / similarity - 1):
                continue
            if lone[max(q - x0 - SHINGLE + 1, 0)] - lone[p - x0] > (1 - similarity) * (size - SHINGLE + 1):
                continue
            tried.append((p, q, d, e, len(hashes), len(chain)))
        last = None
        for p, q, d, e, n, held in reversed(tried):  # the longest first, then each a tenth shorter
            if last is not None and q - p > 0.9 * last:
                continue
            last = q - p
            alike = _set_similarity(x[p - x0 : q - x0], y[p - d - y0 : q - e - y0])
            if alike >= similarity:
                best = (p, q, p - d, n, alike), chain[:held]
                break
        if best:
            out.append(best)
            i = best[1][-1] + 1
        else:
            i += 1
    return out


def _found_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], _COLUMNS)


def _verify(enough: int, min_words: int, similarity: float):
    def run(batches):
        for batch in batches:
            lists = batch.column("met")
            offs, flat = lists.offsets.to_numpy(), lists.values
            arrays = [flat.field(k).to_numpy(zero_copy_only=False) for k in ("at", "reach", "first", "first_reach")]
            numbers = [batch.column(c).to_pylist() for c in ("doc_id", "first_doc_id", "x0", "y0")]
            rows = []
            for i, (doc, first, x0, y0) in enumerate(zip(*numbers)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u4") for c in ("x", "y"))
                met = tuple(a[offs[i] : offs[i + 1]] for a in arrays)
                rows += [(doc, a, b, first, c, h, s) for a, b, c, h, s in matched(x, x0, y, y0, met, enough, min_words, similarity)]
            if rows:
                yield _found_rows(rows)

    return run


_COLUMNS = ["doc_id", "start_word", "end_word", "first_doc_id", "first_word", "n_hashes", "similarity"]
_FOUND = "doc_id long, start_word long, end_word long, first_doc_id long, first_word long, n_hashes long, similarity double"


def _left(reach: str):
    return F.shiftright(reach, 48)


def _right(reach: str):
    return F.shiftright(reach, 32).bitwiseAND(_FAR)


def _verified(pairs: DataFrame, words: DataFrame, enough: int, min_words: int, similarity: float) -> DataFrame:
    """pairs (doc_id, first_doc_id, met, x0, x1, y0, y1: the words that the windows cover) -> passages."""
    part = lambda lo, hi: F.expr(f"substring(words, cast(4 * {lo} + 1 as int), cast(4 * ({hi} - {lo}) as int))")
    both = pairs.join(words, "doc_id").withColumn("x", part("x0", "x1")).drop("words")
    both = both.join(words.toDF("first_doc_id", "words"), "first_doc_id").withColumn("y", part("y0", "y1")).drop("words")
    return both.select("doc_id", "first_doc_id", "met", "x0", "y0", "x", "y").mapInArrow(C.trimmed(_verify(enough, min_words, similarity)), _FOUND)


_FACTOR = 0xD1342543DE82EF95
_UNFACTOR = pow(_FACTOR, -1, 1 << 64)


def _runs_of(span: int):
    """doc_id, words, spots (at, reach), cuts -> every run of `span` shingles around a spot, as far as it is the minimum: key, first place, and
    the places that no cut covers."""

    def run(batches):
        size = span + SHINGLE - 1
        for batch in batches:
            spots, cuts = batch.column("spots"), batch.column("cuts")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                w = C.mix(np.frombuffer(batch.column("words")[i].as_buffer(), "<u4").astype(np.uint64) + np.uint64(1))
                starts = len(w) - size + 1
                if starts < 1:
                    continue
                at, reach = (spots[i].values.field(k).to_numpy(zero_copy_only=False) for k in ("at", "reach"))
                low = np.maximum(at - np.minimum(reach >> 48, span - 1), 0)
                high = np.minimum(at + np.minimum((reach >> 32) & _FAR, span - 1) - span + 1, starts - 1)
                mark = np.zeros(starts + 1, np.int64)
                good = low <= high
                np.add.at(mark, low[good], 1)
                np.add.at(mark, high[good] + 1, -1)
                place = np.flatnonzero(np.cumsum(mark)[:starts])
                if not len(place):
                    continue
                shut = np.zeros(starts + 1, np.int64)
                if cuts[i].is_valid:
                    a, b = (cuts[i].values.field(k).to_numpy(zero_copy_only=False) for k in ("start_word", "end_word"))
                    good = (a < starts) & (b - a >= size)
                    np.add.at(shut, a[good], 1)
                    np.add.at(shut, np.minimum(b[good] - size + 1, starts), -1)
                up = np.full(len(w), _FACTOR, np.uint64)
                down = np.full(len(w), _UNFACTOR, np.uint64)
                up[0] = down[0] = 1
                total = np.zeros(len(w) + 1, np.uint64)
                np.cumsum(w * np.multiply.accumulate(up), out=total[1:])
                keys = C.mix((total[place + size] - total[place]) * np.multiply.accumulate(down)[place])
                order = np.argsort(keys, kind="stable")
                keys, place = keys[order], place[order]
                own = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                free = np.cumsum(shut)[place] == 0
                cut = np.concatenate([[0], np.cumsum(free)])[np.r_[own, len(keys)]]
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(keys[own])), pa.array(np.full(len(own), doc)), pa.array(place[own]), C.lists(place[free], cut, pa.int64())], ["k", "doc_id", "at", "open"])

    return run


def _whole_runs(zero: DataFrame, found: DataFrame, words: DataFrame, span: int) -> DataFrame:
    """Passages by equal runs of `span` shingles (exact ones, of any length over that) that no passage found so far covers."""
    cuts = C.written(found.select("doc_id", F.struct("start_word", "end_word").alias("s")).distinct().groupBy("doc_id").agg(F.collect_list("s").alias("cuts")))
    context = lambda c: F.array_distinct(F.transform("places", lambda p: (F.shiftright(p["reach"], 16) if c else p["reach"]).bitwiseAND(0xFFFF)))
    groups = [zero.select("v", "doc_id", F.explode(context(c)).alias("c")).where("c > 0").groupBy("v", "c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least <> last").select("v") for c in (0, 1)]
    alike = C.written(groups[0].unionByName(groups[1]).distinct())
    held = C.join_checked(zero, alike, ["v"], "left_semi")
    low = lambda p: F.greatest(p["at"] - F.least(F.shiftright(p["reach"], 48), F.lit(span - 1)), F.lit(0))
    high = lambda p: p["at"] + F.least(F.shiftright(p["reach"], 32).bitwiseAND(_FAR), F.lit(span - 1)) + SHINGLE
    covered = F.forall("places", lambda p: F.coalesce(F.exists("cuts", lambda c: (c["start_word"] <= low(p)) & (c["end_word"] >= high(p))), F.lit(False)))
    held = C.written(held.join(cuts.hint("merge"), "doc_id", "left").select("v", "doc_id", "places", covered.alias("covered")))
    values = C.written(held.where("not covered").select("v").distinct())
    spots = C.join_checked(held, values, ["v"], "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("places")).alias("spots"))
    rows = spots.join(cuts.hint("merge"), "doc_id", "left").join(words.hint("merge"), "doc_id").select("doc_id", "words", "spots", "cuts")
    runs = C.written(rows.mapInArrow(C.trimmed(_runs_of(span)), "k long, doc_id long, at long, open array<long>"))
    first = runs.groupBy("k").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("last"), F.max(F.size("open")).alias("any")).where("any > 0 and f.doc_id <> last").select("k", F.col("f.doc_id").alias("first_doc_id"), F.col("f.at").alias("first_word"))
    met = runs.where("size(open) > 0").join(first.hint("merge"), "k").where("doc_id <> first_doc_id").select("doc_id", "first_doc_id", "first_word", F.explode("open").alias("start_word"))
    # Overlapping runs on one diagonal are one passage, and so are runs that start word by word (a text that repeats itself).
    met = met.groupBy("doc_id", "first_doc_id", "start_word").agg(F.min("first_word").alias("first_word"))
    line = Window.partitionBy("doc_id", "first_doc_id").orderBy("start_word")
    gap, same = F.col("start_word") - F.lag("start_word").over(line), F.lag(F.col("start_word") - F.col("first_word")).over(line) == F.col("start_word") - F.col("first_word")
    parts = met.withColumn("fresh", (~F.coalesce((gap == 1) | (same & (gap <= span)), F.lit(False))).cast("int")).withColumn("part", F.sum("fresh").over(line))
    merged = parts.groupBy("doc_id", "first_doc_id", "part").agg(F.min("start_word").alias("start_word"), (F.max("start_word") + span + SHINGLE - 1).alias("end_word"), F.min_by("first_word", "start_word").alias("first_word"))
    out = C.written(merged.withColumns({"n_hashes": F.lit(HASHES).cast("long"), "similarity": F.lit(1.0)}).select(*_COLUMNS))
    C.tidy(cuts, alike, held, values, runs)
    return out


def _several(docs: DataFrame) -> DataFrame:
    """(doc_id, key, row): the rows of doc_ids that have different texts, by text hash, with a number that stands for each."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("key"))
    odd = keys.groupBy("doc_id").agg(F.min("key").alias("least"), F.max("key").alias("last")).where("least <> last")
    texts = C.join_checked(keys, C.written(odd.select("doc_id", "least")), ["doc_id"], "inner").distinct()
    apart = F.shiftrightunsigned(F.xxhash64("doc_id", "key"), 2).bitwiseOR(F.lit(1 << 62))
    return C.written(texts.select("doc_id", "key", F.when(F.col("key") == F.col("least"), F.col("doc_id")).otherwise(apart).alias("row")))


def passages(docs: DataFrame, span: int = SPAN, enough: int = ENOUGH, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Repeated passages: doc_id, start_word, end_word (words from 0, end exclusive), first_doc_id, first_word, n_hashes, similarity, text_key.

    text_key is the text's hash (xxhash64) where a doc_id has several texts, else null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    several = _several(docs)
    some = several.limit(1).count() > 0
    if some:
        keyed = C.join_checked(docs.withColumn("key", F.xxhash64("text")), several, ["doc_id", "key"], "left")
        docs = keyed.select(F.coalesce("row", "doc_id").alias("doc_id"), "text")
    found = _passages(docs, span, enough, min_words, similarity)
    if not some:
        return found.withColumn("text_key", F.lit(None).cast("long"))
    own = several.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("real"), F.col("key").alias("text_key"))
    found = C.join_checked(found, C.written(own), ["doc_id"], "left").withColumn("doc_id", F.coalesce("real", "doc_id")).drop("real")
    first = C.written(several.select(F.col("row").alias("first_doc_id"), F.col("doc_id").alias("real")))
    found = C.join_checked(found, first, ["first_doc_id"], "left").withColumn("first_doc_id", F.coalesce("real", "first_doc_id"))
    return found.select(*_COLUMNS, "text_key")


def _passages(docs: DataFrame, span: int, enough: int, min_words: int, similarity: float) -> DataFrame:
    windows = docs.mapInArrow(C.trimmed(_windows(span)), _WINDOWS).select("doc_id", F.inline("windows"))
    # A value's first window is found by partial aggregation and joined back, so a passage that many texts share is split over tasks.
    first = windows.groupBy("v").agg(F.min(F.struct("doc_id", "at", "reach")).alias("f"), F.max("doc_id").alias("last"), (F.count("*") > 2).alias("docs"), F.max(F.size("more") > 0).alias("places"))
    first = C.written(first.where("f.doc_id <> last").select("v", "f", (F.col("docs") | F.col("places")).alias("many")))
    shared = C.written(windows.join(first.hint("merge"), "v").select("v", "doc_id", "at", "reach", "more", "f", "many"))
    C.tidy(first)
    met = shared.where("doc_id <> f.doc_id").select("doc_id", F.col("f.doc_id").alias("first_doc_id"), "at", "reach", F.col("f.at").alias("first"), F.col("f.reach").alias("first_reach"))
    place, other = F.col("at").bitwiseAND(_MASK), F.col("first").bitwiseAND(_MASK)
    pairs = met.groupBy("doc_id", "first_doc_id").agg(
        F.collect_list(F.struct("at", "reach", "first", "first_reach")).alias("met"),
        F.size(F.collect_set(F.shiftright("at", 48))).alias("hashes"),
        F.min(place - _left("reach")).alias("x0"),
        (F.max(place + _right("reach")) + SHINGLE).alias("x1"),
        F.min(other - _left("first_reach")).alias("y0"),
        (F.max(other + _right("first_reach")) + SHINGLE).alias("y1"),
    )
    pairs = C.written(pairs.where(F.col("hashes") >= enough).drop("hashes"))
    ids = C.written(shared.select("doc_id").distinct())
    words = C.written(C.join_checked(docs, ids, ["doc_id"], "left_semi").mapInArrow(C.trimmed(_words32), "doc_id long, words binary"))
    found = C.written(_verified(pairs, words, enough, min_words, similarity).distinct())
    # A value that just two documents hold, at one place each, and that have been compared, has no more to show.
    zero = shared.where(F.col("at") <= _MASK).select("v", "doc_id", F.concat(F.array(F.struct("at", "reach")), "more").alias("places"), "many", F.col("f.doc_id").alias("first_doc_id"))
    two = zero.where("not many and doc_id <> first_doc_id").join(pairs.select("doc_id", "first_doc_id").hint("merge"), ["doc_id", "first_doc_id"], "left_anti")
    more = C.written(two.select("v").distinct())
    zero = C.written(zero.where("many").unionByName(C.join_checked(zero.where("not many"), more, ["v"], "left_semi")).drop("many", "first_doc_id"))
    C.tidy(pairs, ids, more)
    return found.unionByName(_whole_runs(zero, found, words, span)).distinct()


def _cut(schema_names: list[str]):
    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_tessera_spans").to_pylist()):
                if not text or not spans:
                    texts.append(text)
                    continue
                raw = text.encode()
                starts, ends, _, _ = C.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), hashes=False)
                keep, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start_word"], s["end_word"])):
                    a, b = s["start_word"], min(s["end_word"], len(starts))
                    if a > at:
                        keep.append((at, a))
                    at = max(at, b)
                if at < len(starts):
                    keep.append((at, len(starts)))
                texts.append("\n".join(raw[starts[a] : ends[b - 1]].decode() for a, b in keep))
            out = pa.Table.from_batches([batch]).drop_columns(["text", "_tessera_spans"]).append_column("text", pa.array(texts, pa.string()))
            yield from out.select(schema_names).combine_chunks().to_batches()

    return run


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the found passages cut out of text (what stays on both sides is joined by a newline) and n_chars counted anew if there is one.

    Passages with a text_key are cut from rows of that text only.
    """
    found = C.written(found.select("doc_id", "text_key", F.struct("start_word", "end_word").alias("s")).distinct())
    spans = C.written(found.groupBy("doc_id", "text_key").agg(F.collect_list("s").alias("_tessera_spans")))
    joined = C.join_checked(docs, spans.where("text_key is null").drop("text_key"), ["doc_id"], "left")
    if spans.where("text_key is not null").limit(1).count():
        own = spans.where("text_key is not null").select("doc_id", F.col("text_key").alias("_tessera_key"), F.col("_tessera_spans").alias("_tessera_own"))
        joined = C.join_checked(joined.withColumn("_tessera_key", F.xxhash64("text")), own, ["doc_id", "_tessera_key"], "left")
        joined = joined.withColumn("_tessera_spans", F.coalesce("_tessera_own", "_tessera_spans"))
    out = joined.select(*docs.columns, "_tessera_spans").mapInArrow(C.trimmed(_cut(docs.columns)), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
