"""Live count-or-idle batching: a buffer for each group that is flushed after `size` rows, or when no row came for a gap.

A stateful processor with a timer that every row sets anew. In event time, rows wait in state until the watermark has passed them and are then
taken in the order of their time, so a stream gives the batches of `ingest.idle_batches` on the same rows, whatever micro-batches they
came in; rows behind the watermark are dropped. In processing time, rows count as they arrive. State lives in the
checkpoint: a restarted query goes on with the buffers it had. Without groups there is one buffer, kept by one task, as a single
listener has it; give groups where the feed is large.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COUNT, IDLE = "count", "idle"
#: State is held by the RocksDB provider, which transformWithState needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of one value of the state.
PACK = 1024


def _packed(rows: list[tuple]) -> list[tuple]:
    """Rows as few values: each value of a list state is encoded on both sides of the call."""
    return [(pickle.dumps(rows[i : i + PACK]),) for i in range(0, len(rows), PACK)]


def _unpacked(state) -> list[tuple]:
    return [row for (part,) in state.get() for row in pickle.loads(part)]


class Batcher(StatefulProcessor):
    """Rows (at: microseconds, then what orders equal times, then the rest) -> the rows of each flushed batch with session, chunk and reason."""

    def __init__(self, columns: list[str], groups: list[str], order: list[str], gap_us: int, size: int, live: bool):
        self.columns, self.groups, self.order, self.gap_us, self.size, self.live = columns, groups, [columns.index(c) for c in order], gap_us, size, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "session long, chunk long, held int, last_us long, timer_ms long")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.buffer = handle.getListState("buffer", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = sorted((tuple(r[c] for c in self.columns) for r in rows), key=self._by)
        if self.live:
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            yield from self._take([(now, *r[1:]) for r in fresh], key, None)
            return
        mark, passed = self._mark(), timerValues.getCurrentWatermarkInMs()
        if fresh and fresh[0][0] > passed * 1000 and (mark[4] is None or passed < mark[4]):
            # Nothing is due before the timer, so the rows join those that wait, which aren't read.
            self.waiting.appendList(_packed(fresh))
            at = min(fresh[0][0] // 1000 + 1, mark[4] if mark[4] is not None else sys.maxsize)
            self._timer(mark[4], at)
            if at != mark[4]:
                self.mark.update((*mark[:4], at))
            return
        yield from self._release(key, passed * 1000, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.live:
            yield from self._take([], key, timerValues.getCurrentProcessingTimeInMs() * 1000)
        else:
            yield from self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _by(self, row: tuple) -> tuple:
        return (row[0], *((row[i] is not None, row[i]) for i in self.order))

    def _mark(self) -> tuple:
        return self.mark.get() or (0, 0, 0, None, None)

    def _timer(self, old: int | None, new: int | None) -> None:
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def _release(self, key, watermark: int, fresh: list[tuple] = ()) -> Iterator[Row]:
        held = _unpacked(self.waiting)
        ready = sorted((r for r in [*held, *fresh] if r[0] <= watermark), key=self._by)
        later = [r for r in [*held, *fresh] if r[0] > watermark]
        if ready and held:
            self.waiting.put(_packed(later)) if later else self.waiting.clear()
        elif fresh and later:
            self.waiting.put(_packed(later))
        yield from self._take(ready, key, watermark, min((r[0] for r in later), default=None))

    def _take(self, ready: list[tuple], key, now: int | None, next_us: int | None = None) -> Iterator[Row]:
        """Add rows in order and flush; now: the time that has surely passed."""
        session, chunk, held, last, timer = self._mark()
        stored = held > 0
        own = _unpacked(self.buffer) if stored else []
        before = (session, chunk, held, last)
        for row in ready:
            if last is None or row[0] - last > self.gap_us:
                yield from self._flush(key, own, session, chunk, IDLE)
                own, session, chunk = [], session + 1, 0
            elif not own and held == -1:  # the last batch was full, and the session goes on
                chunk += 1
            own.append(row)
            last, held = row[0], len(own)
            if held == self.size:
                yield from self._flush(key, own, session, chunk, COUNT)
                own, held = [], -1
        if own and now is not None and now - last > self.gap_us:
            yield from self._flush(key, own, session, chunk, IDLE)
            own, held = [], 0
        if (session, chunk, held, last) != before or ready:
            if own:
                self.buffer.put(_packed(own))
            elif stored:
                self.buffer.clear()
        wanted = [next_us] if next_us is not None else []
        wanted += [last + self.gap_us] if own else []
        at = min(wanted) // 1000 + 1 if wanted else None
        self._timer(timer, at)
        self.mark.update((session, chunk, held, last, at))

    def _flush(self, key, rows: list[tuple], session: int, chunk: int, reason: str) -> Iterator[Row]:
        names = [*self.groups, *self.columns[1:], "_at_us", "session", "chunk", "reason"]
        made, lead = Row(*names), key[: len(self.groups)]
        for row in rows:
            yield made(*lead, *row[1:], row[0], session, chunk, reason)

    def close(self) -> None:
        pass


def live_batches(events: DataFrame, ts: str, gap: str, size: int, groups: list[str] | None = None, order: list[str] | None = None, late: str = "10 minutes", live: bool = False) -> DataFrame:
    """The rows of a stream with `session`, `chunk` and `reason` (count or idle), each when its batch is flushed. Write it in append mode.

    gap, late: intervals like '30 seconds'. live: by arrival instead of the column ts, which then may be any column. Needs the RocksDB state store.
    """
    groups, order = groups or [], order or []
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    gap_us = spark.sql(f"SELECT timestampdiff(MICROSECOND, timestamp'2000-01-01', timestamp'2000-01-01' + interval {gap}) AS g").first()["g"]
    timed = events.withColumn("_at", F.col(ts).cast("timestamp"))
    timed = timed if live else timed.withWatermark("_at", late)
    rest = [c for c in events.columns if c not in groups]
    rows = timed.withColumn("_at_us", F.unix_micros("_at"))
    kind = {f.name: f for f in events.schema.fields}
    columns = ["_at_us", *rest]
    out = T.StructType([*[T.StructField(c, kind[c].dataType) for c in [*groups, *rest]], T.StructField("_at_us", T.LongType()), T.StructField("session", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("reason", T.StringType())])
    by = groups or ["_all"]
    if not groups:
        rows = rows.withColumn("_all", F.lit(1))
    processor = Batcher(columns, groups, order, gap_us, size, live)
    found = rows.groupBy(*by).transformWithState(processor, out, "append", "ProcessingTime" if live else "EventTime")
    return found.drop("_at_us")
