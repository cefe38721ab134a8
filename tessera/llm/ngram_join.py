"""N-gram Jaccard join by signature trees.

A document is the set of its 5-word shingles (A-Z lower-cased, 64-bit hashes); two link at a Jaccard similarity of
0.8 or more. The join is exact over the hashes:

1. Equal sets are one class with one representative (grouped by set fingerprint, partial aggregation).
2. The root. Its OR holds every shingle, one row each, dealt out by shingle (the lowest SHARE of the hash range: a part of
   the shingle space that is the same for all sets and counted whole). A document overlaps any other by its size less
   the shingles that no other set has, at most; those that can't reach 0.8 so go. What is left are near copies and documents made of
   shared passages.
3. Every document left is held against one hub: of the documents that share a min-hash with it, the one with the fewest
   shingles of its own (an original has fewer than its edited copies). So a group of thousands of near copies costs
   one check per member, and most of it is one component before the tree is built.
4. The tree. Documents are put in order by size class, the least min-hash of their component, component and min-hash, and cut
   into leaves of LEAF documents; FAN leaves make a branch. Nodes hold their size range, the range of their components and the OR of
   their documents' prefix bitmaps (over 2^32 positions, kept as the sorted positions that are set). Two sets that link share one
   of their first n - ceil(0.8 n) + 1 shingles in a common order, so branches meet where they share such a prefix shingle. The
   dual traversal goes down from two branches to leaves and documents; it ends where sizes can't reach 0.8, where all is
   one component, where the ORs have nothing in common, and at documents whose prefixes' common positions plus the longer
   of the rests, the greatest overlap possible, are too few. Only then the sets of the documents left are fetched, and
   overlaps are counted exactly. A pair of leaves yields a forest of links, not its pairs.

The order of shingles is by frequency among the documents left, as far as it is over HEAVY (of at most HEAVY_LIST shingles, the
most frequent), then by hash. Any fixed order is exact; this one keeps common passages out of the prefixes. Links inside
a component known so far aren't listed, so components are complete though not all links are.

Defined cases: null and empty texts have an empty set and link with nothing; texts of 1 to 4 words are one shingle; a
null doc_id links with nothing and has a null component; rows that repeat a doc_id are one node (its texts' links
together); an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZE, PERCENT, HASHES, HEAVY, HEAVY_LIST, LEAF, LEAF_TOKENS, FAN, SHARE = 5, 80, 4, 8, 500_000, 64, 1 << 18, 16, 0.4
#: Bytes of sets in one partition of the tree's order.
PART_BYTES = 32 << 20


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    return n - -(-n * percent // 100) + 1


def _sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of every text."""
    for _, data, offs in C.chunks(column):
        _, _, hashes, per = C.words(data, offs)
        values, cuts = C.shingles(hashes, per, size)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield np.unique(values[a:b])


def _profile(size: int):
    """doc_id -> n and two fingerprints of the set."""

    def run(batches):
        for batch in batches:
            n, f1, f2 = [], [], []
            for u in _sets(batch.column("text"), size):
                m = C.mix(u)
                n.append(len(u))
                f1.append(m.sum(dtype=np.uint64))
                f2.append(np.bitwise_xor.reduce(C.mix(m + np.uint64(1))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(C.signed(np.array(f, np.uint64))) for f in (f1, f2))], ["doc_id", "n", "f1", "f2"])

    return run


def _lowest(size: int, share: float):
    """text -> each set's fingerprint and its shingles in the lowest share of the hash range."""

    def run(batches):
        top = np.uint64(int(share * (1 << 64)))
        for batch in batches:
            for some in itertools.batched(_sets(batch.column("text"), size), 512):
                found = [u[: np.searchsorted(u, top)] for u in some]
                marks = np.array([C.mix(u).sum(dtype=np.uint64) for u in some], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(marks)), C.lists(C.signed(np.concatenate(found)), np.concatenate([[0], np.cumsum([len(u) for u in found])]), pa.int64())], ["f1", "low"])

    return run


def _whole(size: int):
    """doc_id, alone -> n, alone, min-hashes and the set as bytes; empty sets go."""

    def run(batches):
        seeds = C.mix(np.arange(901, 901 + HASHES, dtype=np.uint64))
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("alone").to_pylist(), _sets(batch.column("text"), size))
            for part in itertools.batched((r for r in rows if len(r[2])), 512):
                mins = [C.signed(np.array([C.mix(u ^ s).min() for s in seeds])) for _, _, u in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([len(r[2]) for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), C.lists(np.concatenate(mins), np.arange(len(part) + 1) * HASHES, pa.int64()), pa.array([r[2].tobytes() for r in part], pa.binary())],
                    ["doc_id", "n", "alone", "mins", "u"],
                )

    return run


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _prefix(u: np.ndarray, heavy: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order: those of `heavy` (sorted) last, by rank, else by hash."""
    if len(heavy):
        spot = np.minimum(np.searchsorted(heavy, u), len(heavy) - 1)
        often = heavy[spot] == u
        u = np.concatenate([u[~often], u[often][np.argsort(rank[spot[often]], kind="stable")]])
    return u[: int(prefix_length(len(u), percent))]


def _every(batches):
    for batch in batches:
        for u in batch.column("u"):
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(_tokens(u.as_py())))], ["s"])


def _linked(percent: int):
    """(a, ua, b, ub) -> the pairs that link."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ua"), batch.column("ub"))):
                x, y = _tokens(x.as_py()), _tokens(y.as_py())
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared * (100 + percent) >= percent * (len(x) + len(y)):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


# ---- the tree ----


def node(leaf: int, docs: list[tuple[int, int, int, np.ndarray]]) -> dict:
    """A leaf of documents (id, component, size, prefix). Positions of bitmaps are the lowest 32 bits of hashes."""
    ids, components, sizes, prefixes = (list(x) for x in zip(*docs))
    places = [np.unique(p.astype("<u4")) for p in prefixes]
    return {"leaf": leaf, "n_min": min(sizes), "n_max": max(sizes), "low": min(components), "high": max(components), "either": np.unique(np.concatenate(places)).tobytes(), "ids": ids, "components": components, "sizes": sizes, "held": [len(x) for x in places], "places": b"".join(x.tobytes() for x in places)}


def overlaps(x: list[np.ndarray], y: list[np.ndarray], common: np.ndarray | None = None, columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of the sets of x with those of y, by products over their common members."""
    flat = [np.concatenate(s) for s in (x, y)]
    if common is None:
        common = np.intersect1d(*flat)
    total = np.zeros((len(x), len(y)), np.int64)
    if not len(common):
        return total
    at = []
    for sets, values in zip((x, y), flat):
        spot = np.minimum(np.searchsorted(common, values), len(common) - 1)
        good = common[spot] == values
        at.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[good], spot[good]))
    for lo in range(0, len(common), columns):
        hold = []
        for (row, spot), n in zip(at, (len(x), len(y))):
            inside = (spot >= lo) & (spot < lo + columns)
            m = np.zeros((n, min(columns, len(common) - lo)), np.float32)
            m[row[inside], spot[inside] - lo] = 1
            hold.append(m)
        total += (hold[0] @ hold[1].T).astype(np.int64)
    return total


def may_link(a: dict, b: dict, percent: int = PERCENT) -> tuple[list[int], list[int]] | None:
    """The documents of two leaves that may link with one of the other leaf and of another component, or None."""
    if a["low"] == a["high"] == b["low"] == b["high"]:
        return None
    if a["n_max"] * 100 < b["n_min"] * percent or b["n_max"] * 100 < a["n_min"] * percent:
        return None
    common = np.intersect1d(np.frombuffer(a["either"], "<u4"), np.frombuffer(b["either"], "<u4"), assume_unique=True)
    if not len(common):
        return None
    parts = [np.split(np.frombuffer(x["places"], "<u4"), np.cumsum(x["held"])[:-1]) for x in (a, b)]
    n, m = (np.array(x["sizes"], np.int64) for x in (a, b))
    shared = overlaps(*parts, common)
    most = shared + np.maximum((n - prefix_length(n, percent))[:, None], m - prefix_length(m, percent))
    good = (shared > 0) & (most * (100 + percent) >= percent * (n[:, None] + m)) & (np.array(a["components"])[:, None] != np.array(b["components"]))
    return ([a["ids"][i] for i in np.flatnonzero(good.any(1))], [b["ids"][j] for j in np.flatnonzero(good.any(0))]) if good.any() else None


def traverse(a: list[dict], b: list[dict] | None, percent: int = PERCENT):
    """(leaf, leaf, documents, documents) of two branches, or of one if b is None, that may link."""
    for x, y in itertools.combinations_with_replacement(a, 2) if b is None else itertools.product(a, b):
        found = may_link(x, y, percent)
        if found:
            yield x["leaf"], y["leaf"], *found


def _tree(heavy: np.ndarray, rank: np.ndarray, percent: int):
    """Documents in order -> branches (branch, size range, nodes, prefix shingles)."""

    def run(batches):
        task, count = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, itertools.count()
        held, nodes, first = [], [], []
        class_, tokens = None, 0

        def leaf():
            nodes.append(node(task | next(count), held))
            first.append(np.unique(np.concatenate([r[3] for r in held])))
            held.clear()

        def branch():
            out = (nodes[0]["leaf"], min(x["n_min"] for x in nodes), max(x["n_max"] for x in nodes), list(nodes), C.signed(np.unique(np.concatenate(first))))
            nodes.clear(), first.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, _BRANCH)], schema=_BRANCH)

        for batch in batches:
            for doc, component, kind, u in zip(*(batch.column(c) for c in ("doc_id", "component", "class", "u"))):
                u = _tokens(u.as_py())
                if held and (kind.as_py() != class_ or len(held) >= LEAF or tokens + len(u) > LEAF_TOKENS):
                    leaf()
                    tokens = 0
                    if len(nodes) >= FAN:
                        yield branch()
                held.append((doc.as_py(), component.as_py(), len(u), _prefix(u, heavy, rank, percent)))
                class_, tokens = kind.as_py(), tokens + len(u)
        if held:
            leaf()
        if nodes:
            yield branch()

    return run


_LONGS = pa.list_(pa.int64())
_NODE = pa.struct([("leaf", pa.int64()), ("n_min", pa.int64()), ("n_max", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("either", pa.binary()), ("ids", _LONGS), ("components", _LONGS), ("sizes", _LONGS), ("held", _LONGS), ("places", pa.binary())])
_BRANCH = pa.schema([("branch", pa.int64()), ("n_min", pa.int64()), ("n_max", pa.int64()), ("nodes", pa.list_(_NODE)), ("tokens", _LONGS)])
_BRANCH_SQL = "branch long, n_min long, n_max long, nodes array<struct<leaf:long,n_min:long,n_max:long,low:long,high:long,either:binary,ids:array<long>,components:array<long>,sizes:array<long>,held:array<long>,places:binary>>, tokens array<long>"


def _descend(percent: int):
    """Pairs of branches (x, y; y null for a branch with itself) -> (p, q, side, doc_id): the documents of leaves p and q to compare."""

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                for p, q, a, b in traverse(x.as_py(), y.as_py(), percent):
                    n = len(a) + len(b)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * n, pa.int64()), pa.array([q] * n, pa.int64()), pa.array([0] * len(a) + [1] * len(b), pa.int32()), pa.array(a + b, pa.int64())], ["p", "q", "side", "doc_id"])

    return run


def links(a: tuple, b: tuple, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the links between documents (ids, components, sets) of different components."""
    sizes = [np.array([len(u) for u in side[2]]) for side in (a, b)]
    good = (overlaps(a[2], b[2]) * (100 + percent) >= percent * (sizes[0][:, None] + sizes[1])) & (np.array(a[1])[:, None] != np.array(b[1]))
    parent: dict[int, int] = {}

    def find(c):
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(good))):
        p, q = find(a[1][i]), find(b[1][j])
        if p != q:
            parent[p] = q
            out.append((a[0][i], b[0][j]))
    return out


def _compare(percent: int):
    """All rows (side, doc_id, component, u) of one pair of leaves -> links."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        sides = []
        for k in (0, 1):
            part = table.filter(pa.array(side == k))
            sides.append((part.column("doc_id").to_pylist(), part.column("component").to_pylist(), [_tokens(u.as_py()) for u in part.column("u")]))
        found = links(*sides, percent) if len(sides[0][0]) and len(sides[1][0]) else []
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


_EDGES = "a long, b long"


def _size_class(percent: int):
    """Sets that link are of the same or neighbouring classes."""
    return F.floor(F.log("n") / float(np.log(100 / percent))).cast("long")


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """profile (doc_id, n, f1, f2), copies (a, b): documents and the smallest one of their set, and those smallest ones (doc_id, n, f1)."""
    profile = C.written(docs.mapInArrow(C.trimmed(_profile(size)), "doc_id long, n long, f1 long, f2 long"))
    full = profile.where("n > 0 and doc_id is not null")
    classes = C.written(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last"))
    of = C.join_checked(full, classes, ["n", "f1", "f2"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    copies = C.written(of.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    single = C.written(of.where("doc_id = rep").select("doc_id", "n", "f1"))
    C.tidy(classes)
    return profile, copies, single


def _survivors(docs: DataFrame, single: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, alone) of the smallest documents of their sets that the root can't rule out. Shingles that only equal sets hold are a set's own."""
    low = docs.mapInArrow(C.trimmed(_lowest(size, SHARE)), "f1 long, low array<long>")
    alone = low.select("f1", F.explode("low").alias("s")).groupBy("s").agg(F.min("f1").alias("f1"), F.max("f1").alias("other")).where("f1 = other")
    alone = C.written(alone.groupBy("f1").agg(F.count("*").alias("alone")))
    own = F.coalesce("alone", F.lit(0))
    left = single.join(alone.hint("merge"), "f1", "left").where(F.col("n") - own >= F.ceil(F.col("n") * percent / 100))
    left = C.written(left.groupBy("doc_id").agg(F.max(own).alias("alone")))
    C.tidy(alone)
    return left


def _stars(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of documents and the hub that each is held against."""
    hashed = C.written(sets.select(F.col("doc_id").alias("a"), "alone", _size_class(percent).alias("class"), F.posexplode("mins").alias("i", "v")))
    hubs = C.written(hashed.groupBy("i", "v", "class").agg(F.min(F.struct("alone", "a")).alias("hub"), F.min("a").alias("least"), F.max("a").alias("last")).where("least <> last").select("i", "v", "class", "hub"))
    best = C.join_checked(hashed, hubs, ["i", "v", "class"], "inner").where("a <> hub.a").groupBy("a").agg(F.min("hub").alias("hub"))
    asked = C.written(best.select("a", F.col("hub.a").alias("b")))
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("u").alias(f"u{k}"))
    both = asked.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    out = C.written(both.select("a", "ua", "b", "ub").mapInArrow(C.trimmed(_linked(percent)), _EDGES).distinct())
    C.tidy(hashed, hubs, asked)
    return out


def _tree_links(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components, by the tree."""
    often = sets.select("u").mapInArrow(C.trimmed(_every), "s long").groupBy("s").count().where(F.col("count") > HEAVY)
    heavy = often.orderBy(F.desc("count"), "s").limit(HEAVY_LIST).toArrow()
    s, rank = np.asarray(heavy.column("s").combine_chunks()).view(np.uint64), np.arange(heavy.num_rows, 0, -1)
    order = np.argsort(s)
    joined = sets.select("doc_id", "n", "mins", "u").join(known.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component"), _size_class(percent).alias("class"), F.col("mins")[0].alias("m0"), F.col("mins")[1].alias("m1"), "u")
    joined = C.written(joined)
    least = C.written(joined.groupBy("component").agg(F.min("m0").alias("least"), F.count("*").alias("held")).where("held > 1").drop("held"))
    placed = joined.join(least.hint("merge"), "component", "left").withColumn("least", F.coalesce("least", "m0"))
    size = sets.agg(F.sum("n")).first()[0] or 0
    by = ["class", "least", "component", "m0", "m1", "doc_id"]
    ranged = placed.repartitionByRange(-(-8 * size // PART_BYTES) + 1, *by).sortWithinPartitions(*by)
    branches = C.written(ranged.select("doc_id", "component", "class", "u").mapInArrow(C.trimmed(_tree(s[order], rank[order], percent)), _BRANCH_SQL))
    C.tidy(least)

    entries = branches.select("branch", "n_min", "n_max", F.explode("tokens").alias("s"))
    x, y = entries.alias("x"), entries.alias("y")
    met = (F.col("x.s") == F.col("y.s")) & (F.col("x.branch") < F.col("y.branch")) & (F.col("x.n_max") * 100 >= F.col("y.n_min") * percent) & (F.col("y.n_max") * 100 >= F.col("x.n_min") * percent)
    pairs = C.written(x.join(y.hint("merge"), met).select(F.col("x.branch").alias("p"), F.col("y.branch").alias("q")).distinct())
    side = lambda k, name: branches.select(F.col("branch").alias(k), F.col("nodes").alias(name))
    two = pairs.join(side("p", "x").hint("merge"), "p").join(side("q", "y").hint("merge"), "q").select("x", "y")
    one = branches.select(F.col("nodes").alias("x"), F.lit(None).cast(branches.schema["nodes"].dataType).alias("y"))
    asked = C.written(two.unionByName(one).mapInArrow(C.trimmed(_descend(percent)), "p long, q long, side int, doc_id long"))
    fetched = asked.join(joined.select("doc_id", "component", "u").hint("merge"), "doc_id")
    out = C.written(fetched.groupBy("p", "q").applyInArrow(_compare(percent), _EDGES).distinct())
    C.tidy(joined, branches, pairs, asked)
    return out


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile, copies, single = _classes(docs, size)
    left = _survivors(docs.where("doc_id is not null").select("text"), single, size, percent)
    sets = C.written(C.join_checked(docs, left, ["doc_id"], "inner").select("doc_id", "alone", "text").mapInArrow(C.trimmed(_whole(size)), "doc_id long, n long, alone long, mins array<long>, u binary"))
    C.tidy(left, single)
    stars = _stars(sets, percent)
    found = stars.unionByName(_tree_links(sets, components(stars), percent))
    C.tidy(sets)
    known = components(copies.unionByName(found))
    out = C.join_checked(profile.select("doc_id", F.col("n").alias("n_shingles")), known, ["doc_id"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def components(edges: DataFrame) -> DataFrame:
    return C.written(C.components(edges).toDF("doc_id", "component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each component the document of the smallest doc_id stays.

    Rows that repeat a doc_id and its text leave once; rows of one doc_id with different texts all stay, as do rows of an
    empty set or a null doc_id. All columns are kept.
    """
    found = C.written(join(docs))
    gone = C.written(found.where("component_id <> doc_id").select("doc_id").distinct())
    out = C.join_checked(docs, gone, ["doc_id"], "left_anti")
    twice = C.written(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not twice.limit(1).count():
        return out
    again = C.join_checked(out, twice, ["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return C.join_checked(out, twice, ["doc_id"], "left_anti").unionByName(again)
