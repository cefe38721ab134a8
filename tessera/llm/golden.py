"""Golden-record survivorship: one record per cluster by a range sort, folds of the partitions and a segmented scan.

Rows are range-partitioned and sorted by (cluster, RECENT), so a giant cluster spans many partitions. One pass folds each partition
in its order: clusters that begin and end inside it come out whole; the cluster it ends with leaves a summary, as it may go on; rows
of the cluster it begins with are put aside, as what they depend on (the cluster's latest time and chosen segment) may lie
in earlier partitions. The heads of all partitions, one short row each, are scanned on the driver in order, segment by segment, which
gives every first cluster its latest time and segment. With these, the rows put aside are folded into one summary
for each partition, and the driver combines the summaries of clusters that cross partitions. What reaches the driver
is two or three rows a partition, however many rows there are; the number of partitions is a setting.

Orders. RECENT: latest updated_at (null last), higher trust, smaller client_id (null last), then a hash of the other columns, so
repeated ids have a fixed order too. A record is stale if its updated_at is null or more than STALE_HOURS before its cluster's
latest. TRUSTED: fresh before stale, higher trust, RECENT. Sources that are not in TRUST, and null, come last.

Defined cases: strings that are empty or blank count as null; balances that are not finite or whose cents don't fit a long
count as null; rows without master_id and client_id form one cluster with a null cluster_id; repeated rows count each and are dealt over
several partitions if they are many; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

TRUST = ("crm", "web", "store", "partner")
STALE_HOURS = 60 * 24
BLANK = r"[^\x20\x09-\x0D]"

_NONE, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_AT = 56  # bits of a row's place: 20 of its partition, 36 of its number there
_ROW = {"updated": pa.int64(), "trust": pa.int64(), "client_id": pa.int64(), "segment": pa.string(), "name": pa.string(), "email": pa.string(), "city": pa.string(), "nation_id": pa.int32(), "balance": pa.int64(), "name_size": pa.int64()}
#: A field's values come from the row of its least key; the size of a name comes before its key.
_VALUES = {"segment": ["segment"], "email": ["email"], "name": ["name"], "balance": ["balance"], "address": ["city", "nation_id"]}
_SUMMARY = {"cluster": pa.int64(), "n_records": pa.int64(), "n_stale": pa.int64(), "latest": pa.int64(), "size": pa.int64()} | {f"{f}_{k}": pa.int64() for f in _VALUES for k in ("key", "from")} | {c: _ROW[c] for f in _VALUES.values() for c in f}
_OUT = {"kind": pa.int32(), "part": pa.int32(), "row": pa.int64()} | _ROW | _SUMMARY
_WHOLE, _OPEN, _TAIL, _HEAD = range(4)


def _ddl(fields: dict) -> str:
    return ", ".join(f"{k} {'string' if t == pa.string() else 'int' if t == pa.int32() else 'long'}" for k, t in fields.items())


def _batch(columns: dict, n: int, **fixed) -> pa.RecordBatch:
    """A batch of _OUT; columns that aren't given are null."""
    columns = columns | {k: pa.array([v] * n, _OUT[k]) for k, v in fixed.items()}
    arrays = [columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in _OUT.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_OUT))


def _plain(a: pa.Array, fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return a.fill_null(fill).to_numpy(zero_copy_only=False).astype(np.int64), a.is_valid().to_numpy(zero_copy_only=False)


def _fold(rows: dict[str, pa.Array], cluster: pa.Array, at: np.ndarray, starts: np.ndarray, stale_us: int, known: tuple | None) -> pa.Table:
    """Consecutive rows -> a summary for each run that begins at `starts`. known: (latest, segment) of the first run's cluster, where earlier rows give them."""
    n, sizes = len(at), np.diff(np.append(starts, len(at)))
    run = np.repeat(np.arange(len(starts)), sizes)
    least = lambda key: np.minimum.reduceat(key, starts)
    has = {c: rows[c].is_valid().to_numpy(zero_copy_only=False) for c in ("segment", "name", "email", "city", "nation_id", "balance")}
    updated, dated = _plain(rows["updated"])
    latest = np.where(dated, updated, _LEAST)[starts]
    first = least(np.where(has["segment"], np.arange(n), n))
    segment = rows["segment"].take(pa.array(first, mask=first == n))
    if known is not None:
        latest[0] = _LEAST if known[0] is None else known[0]
        if known[1] is not None:
            segment = pa.concat_arrays([pa.array([known[1]], pa.string()), segment.slice(1)])
    stale = ~dated | (np.where(dated, latest[run], 0) - updated > stale_us)
    trusted = stale.astype(np.int64) << (_AT + 3) | _plain(rows["trust"])[0] << _AT | at
    same = pc.equal(rows["segment"], segment.take(pa.array(run))).fill_null(False).to_numpy(zero_copy_only=False)
    size = np.where(has["name"], _plain(rows["name_size"])[0], -1)
    longest = np.maximum.reduceat(size, starts)
    filled = has["city"].astype(np.int64) + has["nation_id"]
    keys = {
        "segment": np.where(has["segment"], at, _NONE),
        "email": np.where(has["email"], trusted, _NONE),
        "name": np.where(has["name"] & (size == longest[run]), trusted, _NONE),
        "balance": np.where(has["balance"], (~same).astype(np.int64) << _AT | at, _NONE),
        "address": np.where(filled > 0, (2 - filled) << _AT | at, _NONE),
    }
    count = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    out = {"cluster": cluster.take(pa.array(starts)), "n_records": pa.array(sizes), "n_stale": pa.array(count(stale)), "latest": pa.array(latest, mask=latest == _LEAST), "size": pa.array(longest)}
    for field, columns in _VALUES.items():
        key = least(keys[field])
        of = pa.array(np.where(key == _NONE, 0, (key & ((1 << _AT) - 1)) - at[0]), mask=key == _NONE)
        out |= {f"{field}_key": pa.array(key), f"{field}_from": rows["client_id"].take(of)} | {c: rows[c].take(of) for c in columns}
    return pa.table(out, schema=pa.schema(_SUMMARY))


def _merged(a: dict, b: dict) -> dict:
    """The summary of a cluster's earlier rows a and later rows b."""
    out = a | {k: a[k] + b[k] for k in ("n_records", "n_stale")}
    for field, columns in _VALUES.items():
        order = lambda x: ((-x["size"] if field == "name" else 0), x[f"{field}_key"])  # noqa: B023, E731
        if order(b) < order(a):
            out |= {k: b[k] for k in (*columns, f"{field}_key", f"{field}_from", *(["size"] if field == "name" else []))}
    return out


def _one(summary: dict, kind: int, part: int) -> pa.RecordBatch:
    return _batch({k: pa.array([summary[k]], t) for k, t in _SUMMARY.items()}, 1, kind=kind, part=part)


def _scan(stale_us: int):
    """A partition's rows in order -> whole clusters, its open rows, its tail and its head."""

    def run(batches):
        part, n, head, held, opened = TaskContext.get().partitionId(), 0, None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            at = (part << 36) + n + np.arange(batch.num_rows)
            n += batch.num_rows
            value, given = _plain(batch.column("cluster"))
            starts = np.append(0, np.flatnonzero((value[1:] != value[:-1]) | (given[1:] != given[:-1])) + 1)
            of = lambda i: int(value[i]) if given[i] else None  # noqa: B023, E731
            rows, cluster = {c: batch.column(c) for c in _ROW}, batch.column("cluster")
            if head is None:
                head = {"cluster": of(0), "latest": rows["updated"][0].as_py(), "segment": None}
            opened = opened and of(0) == head["cluster"]
            if opened:
                end = int(starts[1]) if len(starts) > 1 else batch.num_rows
                if head["segment"] is None:
                    head["segment"] = next(iter(rows["segment"].slice(0, end).drop_null().slice(0, 1).to_pylist()), None)
                yield _batch({c: a.slice(0, end) for c, a in rows.items()} | {"cluster": cluster.slice(0, end), "row": pa.array(at[:end])}, end, kind=_OPEN, part=part)
                if end == batch.num_rows:
                    continue
                opened, starts = False, starts[1:] - end
                rows, cluster, at, value, given = {c: a.slice(end) for c, a in rows.items()}, cluster.slice(end), at[end:], value[end:], given[end:]
            goes_on = held is not None and held["cluster"] == of(0)
            found = _fold(rows, cluster, at, starts, stale_us, (held["latest"], held["segment"]) if goes_on else None)
            if goes_on:
                held, found = _merged(held, found.slice(0, 1).to_pylist()[0]), found.slice(1)
            if found.num_rows:
                if held is not None:
                    yield _one(held, _WHOLE, part)
                whole = found.slice(0, found.num_rows - 1).combine_chunks()
                for b in whole.to_batches():
                    yield _batch({k: b.column(k) for k in _SUMMARY}, b.num_rows, kind=_WHOLE, part=part)
                held = found.slice(found.num_rows - 1).to_pylist()[0]
        if head is not None:
            yield _batch({"cluster": pa.array([head["cluster"]], pa.int64()), "latest": pa.array([head["latest"]], pa.int64()), "segment": pa.array([head["segment"]], pa.string())}, 1, kind=_HEAD, part=part)
        if held is not None:
            yield _one(held, _TAIL, part)

    return run


def _heads(rows: list) -> dict[int, tuple]:
    """The segmented scan over heads and tails in order: partition -> (latest, segment) of the cluster it begins with."""
    tails = {r["part"]: r for r in rows if r["kind"] == _TAIL}
    out: dict[int, list] = {}
    cluster, state = None, None
    for head in sorted((r for r in rows if r["kind"] == _HEAD), key=lambda r: r["part"]):
        if state is None or head["cluster"] != cluster:
            cluster, state = head["cluster"], [head["latest"], head["segment"]]
        elif state[1] is None:
            state[1] = head["segment"]
        out[head["part"]] = state  # shared: a segment found later holds for the earlier ones too
        if tail := tails.get(head["part"]):
            cluster, state = tail["cluster"], [tail["latest"], tail["segment"]]
    return {k: tuple(v) for k, v in out.items()}


def _pieces(known: dict[int, tuple], stale_us: int):
    """Open rows -> one summary for each partition of theirs that the task reads."""

    def run(batches):
        held: dict[int, dict] = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for to, start in zip([*(np.flatnonzero(np.diff(parts)) + 1), len(parts)], [0, *(np.flatnonzero(np.diff(parts)) + 1)]):
                if to == start:
                    continue
                cut, part = batch.slice(start, to - start), int(parts[start])
                found = _fold({c: cut.column(c) for c in _ROW}, cut.column("cluster"), cut.column("row").to_numpy(), np.zeros(1, np.int64), stale_us, known[part]).to_pylist()[0]
                held[part] = _merged(held[part], found) if part in held else found
        for part, summary in held.items():
            yield _one(summary, _TAIL, part)

    return run


def _sorted(clients: DataFrame, trust: tuple[str, ...], parts: int) -> DataFrame:
    text = lambda c: F.when(F.col(c).cast("string").rlike(BLANK), F.col(c).cast("string")).alias(c)
    micros = F.unix_micros("updated_at")
    if isinstance(clients.schema["updated_at"].dataType, T.TimestampNTZType):
        micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', updated_at)")
    cents = F.floor(F.col("balance").cast("double") * 100 + 0.5)
    fits = F.abs(F.col("balance").cast("double")) < 9e16
    place = F.nullif(F.array_position(F.array(*map(F.lit, trust)), F.col("source").cast("string")), F.lit(0))
    rows = clients.select(
        F.coalesce("master_id", "client_id").cast("long").alias("cluster"),
        micros.alias("updated"),
        F.coalesce(place, F.lit(len(trust) + 1)).cast("long").alias("trust"),
        F.col("client_id").cast("long").alias("client_id"),
        *[text(c) for c in ("segment", "name", "email", "city")],
        F.col("nation_id").cast("int").alias("nation_id"),
        F.when(fits, cents).cast("long").alias("balance"),
    ).withColumn("name_size", F.length("name").cast("long"))
    others = ["segment", "name", "email", "city", "nation_id", "balance"]
    rows = rows.withColumns({"tie": F.xxhash64(*others, *[F.col(c).isNull() for c in others]), "deal": F.rand(7)})
    order = [F.col("cluster").asc_nulls_first(), F.col("updated").desc_nulls_last(), F.col("trust").asc(), F.col("client_id").asc_nulls_last(), F.col("tie").asc(), F.col("deal").asc()]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie", "deal")


def records(clients: DataFrame, trust: tuple[str, ...] = TRUST, stale_hours: int = STALE_HOURS, parts: int | None = None) -> DataFrame:
    """One record per cluster of clients (client_id, master_id, source, updated_at, name, email, city, nation_id, segment, balance).

    cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance_cents, and for each field the client_id it comes from.
    parts: partitions of the sort, else spark.sql.shuffle.partitions.
    """
    spark = clients.sparkSession
    if not 1 <= len(trust) <= 6:
        raise ValueError("one to six sources are told apart")
    stale_us, parts = stale_hours * 3_600_000_000, parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = C.written(_sorted(clients, trust, parts).mapInArrow(C.trimmed(_scan(stale_us)), _ddl(_OUT)))
    edges = done.where(F.col("kind").isin(_TAIL, _HEAD)).collect()  # two rows a partition
    known = _heads(edges)
    pieces = done.where(F.col("kind") == _OPEN).mapInArrow(_pieces(known, stale_us), _ddl(_OUT)).collect()  # a row for each partition or piece of a file
    crossing: dict[int | None, dict] = {}
    for r in sorted((r.asDict() for r in [*pieces, *(e for e in edges if e["kind"] == _TAIL)]), key=lambda r: r["part"]):
        crossing[r["cluster"]] = _merged(crossing[r["cluster"]], r) if r["cluster"] in crossing else r
    kept = list(_SUMMARY)
    ends = spark.createDataFrame([tuple(r[k] for k in kept) for r in crossing.values()], _ddl(_SUMMARY))
    every = done.where(F.col("kind") == _WHOLE).select(*kept).unionByName(ends)
    return every.select(
        F.col("cluster").alias("cluster_id"),
        "n_records",
        "n_stale",
        *["name", "email", "segment", "city", "nation_id"],
        F.col("balance").alias("balance_cents"),
        *[f"{f}_from" for f in ("name", "email", "segment", "balance", "address")],
    )
