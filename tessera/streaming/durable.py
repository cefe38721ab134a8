"""A durable work queue as keyed state: it outlives the process, hands work out, takes acknowledgements and failures back, and retries.

Everything that happens to the queue is an event in a folder: key, at, kind, attempt, payload, error. Kinds:

enqueue   insert or replace by key; it starts anew and is handed out
ack       the work of this attempt is stored: the item leaves
fail      attempt failed: it is handed out again after base * 2^n seconds, up to max_retries times, then it is a failed item
retry     a failed item goes back to work with no retries counted

A stateful processor keeps one item per key. A hand-out is an output row (key, attempt, payload); until its ack or fail comes, a lease runs,
and when that ends the item is handed out again: that is what a crash between hand-out and ack leads to. Answers
carry the attempt they belong to, so a late ack of replaced or repeated work changes nothing. `work` runs a handler on each micro-batch of
hand-outs and writes its answers as events; handlers must be idempotent by key, like an upsert. Failed items expire after `keep`.

The state is read back by the state data source (`items`), in the columns that `operators.queue` works on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.queue import FAILED, MAX_RETRIES, PENDING, PROCESSING
from .batches import PROVIDER

EVENT = "key string, at timestamp, kind string, attempt long, payload string, error string"
ENQUEUE, ACK, FAIL, RETRY = "enqueue", "ack", "fail", "retry"
_ITEM = "status string, retry_count int, attempt long, created_us long, updated_us long, payload string, error string, timer_ms long"
_FIELDS = [f.split()[0] for f in _ITEM.split(", ")]
_OUT = "key string, action string, attempt long, retry_count int, payload string, error string"
_ORDER = {ENQUEUE: 0, RETRY: 1, ACK: 2, FAIL: 3}


class _Once:
    """A state variable of one key, read at most once and written at most once: each use of the state is a call to the JVM."""

    def __init__(self, state):
        self.state, self.known, self.changed, self.value = state, False, False, None

    def get(self) -> tuple | None:
        if not self.known:
            self.known, self.value = True, self.state.get()
        return self.value

    def set(self, value: tuple | None) -> None:
        self.known, self.changed, self.value = True, True, value

    def write(self) -> None:
        if self.changed:
            self.state.clear() if self.value is None else self.state.update(self.value)


class Queue(StatefulProcessor):
    def __init__(self, max_retries: int, base_s: float, lease_s: float, keep_s: float):
        self.max_retries, self.base_ms, self.lease_ms, self.keep_ms = max_retries, int(base_s * 1000), int(lease_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", _ITEM)
        self.failed = handle.getValueState("failed", _ITEM, ttlDurationMs=self.keep_ms)
        self.attempts = handle.getValueState("attempts", "n long")

    def _open(self) -> None:
        """A key's turn begins: nothing is read yet."""
        self.one, self.lost, self.count = _Once(self.item), _Once(self.failed), _Once(self.attempts)

    def _close(self, timer: int | None) -> None:
        """Its turn ends: what changed is written, and the timer that it began with gives way to the last one."""
        item = self._held()
        last = item["timer_ms"] if item else None
        if timer != last:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if last is not None:
                self.handle.registerTimer(last)
        for state in (self.one, self.lost, self.count):
            state.write()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._open()
        item = self._held()
        timer = item["timer_ms"] if item else None
        for e in sorted(rows, key=lambda r: (r["at"], _ORDER.get(r["kind"], 9), r["attempt"] or 0, r["payload"] or "")):
            at = int(e["at"].timestamp() * 1_000_000)
            item = self._held()
            if e["kind"] == ENQUEUE:
                self.lost.set(None)
                yield self._hand_out(key, dict(retry_count=0, created_us=at, updated_us=at, payload=e["payload"], error=None), now)
            elif e["kind"] == RETRY and self.lost.get():
                old = self._named(self.lost.get())
                self.lost.set(None)
                yield self._hand_out(key, dict(old, retry_count=0, updated_us=at, error=None), now)
            elif item and item["status"] == PROCESSING and e["attempt"] == item["attempt"]:
                if e["kind"] == ACK:
                    self.one.set(None)
                elif e["kind"] == FAIL:
                    if item["retry_count"] < self.max_retries:
                        due = now + self.base_ms * 2 ** item["retry_count"]
                        self.one.set(self._row(dict(item, status=PENDING, retry_count=item["retry_count"] + 1, updated_us=at, error=e["error"], timer_ms=due)))
                    else:
                        self.one.set(None)
                        self.lost.set(self._row(dict(item, status=FAILED, updated_us=at, error=e["error"], timer_ms=None)))
                        yield Row(key=key[0], action=FAILED, attempt=item["attempt"], retry_count=item["retry_count"], payload=item["payload"], error=e["error"])
        self._close(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._open()
        item = self._held()
        # Due for its retry, or its lease has ended: the attempt was lost, which is no failure.
        if item and item["timer_ms"] == expiredTimerInfo.getExpiryTimeInMs():
            yield self._hand_out(key, item, timerValues.getCurrentProcessingTimeInMs())
            self._close(None)

    def _hand_out(self, key, item: dict, now: int) -> Row:
        n = (self.count.get() or (0,))[0] + 1
        self.count.set((n,))
        self.one.set(self._row(dict(item, status=PROCESSING, attempt=n, timer_ms=now + self.lease_ms)))
        return Row(key=key[0], action="hand_out", attempt=n, retry_count=item["retry_count"], payload=item["payload"], error=item["error"])

    @staticmethod
    def _row(item: dict) -> tuple:
        return tuple(item[f] for f in _FIELDS)

    @staticmethod
    def _named(row: tuple) -> dict:
        return dict(zip(_FIELDS, row))

    def _held(self) -> dict | None:
        row = self.one.get()
        return self._named(row) if row else None

    def close(self) -> None:
        pass


def put(events: DataFrame, path: str) -> None:
    """Append queue events (columns of EVENT; those absent are null)."""
    have = set(events.columns)
    names = [f.split()[0] for f in EVENT.split(", ")]
    kinds = dict(f.split() for f in EVENT.split(", "))
    events.select(*[(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in names]).write.mode("append").parquet(path)


def enqueue(rows: DataFrame, path: str) -> None:
    """rows (key, payload) into the queue."""
    put(rows.select("key", "payload").withColumns({"kind": F.lit(ENQUEUE), "at": F.current_timestamp()}), path)


def retry_failed(spark: SparkSession, checkpoint: str, path: str) -> int:
    """All failed items back to work; how many."""
    failed = items(spark, checkpoint).where(F.col("status") == FAILED).select("key").withColumns({"kind": F.lit(RETRY), "at": F.current_timestamp()})
    n = failed.count()
    if n:
        put(failed, path)
    return n


def transitions(events: DataFrame, max_retries: int = MAX_RETRIES, base_s: float = 30.0, lease_s: float = 300.0, keep_s: float = 30 * 86_400.0) -> DataFrame:
    """The stream of hand-outs and final failures of a stream of events."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.where("key is not null and key <> ''").groupBy("key").transformWithState(Queue(max_retries, base_s, lease_s, keep_s), _OUT, "append", "ProcessingTime")


def drained(writer) -> StreamingQuery:
    """Start a stream with processing-time timers that ends when the input there is read. Its timers are looked at with each micro-batch of input,
    not between them, where it would never end."""
    spark, name = SparkSession.active(), "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "false")
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def work(spark: SparkSession, path: str, checkpoint: str, handler: Callable[[DataFrame], DataFrame], interval: str | None = None, files_per_batch: int = 1000, **options) -> StreamingQuery:
    """Run the queue. handler(hand-outs: key, attempt, payload, retry_count) does the work and returns (key, attempt, ok, error).

    Its answers become events of the same folder. If it raises, the micro-batch runs again whole from the same state. Without an interval, what is
    there and what is due is worked off and the query stops; answers are taken by the next run.
    """
    if interval is None:  # an event of no key, so that a micro-batch looks at what is due
        put(spark.range(1).select(F.current_timestamp().alias("at"), F.lit("tick").alias("kind")), path)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def run(batch: DataFrame, batch_id: int) -> None:
        out = batch.where("action = 'hand_out'").select("key", "attempt", "payload", "retry_count").persist()
        try:
            if out.limit(1).count():
                kind = F.when(F.col("ok"), ACK).otherwise(FAIL)
                put(handler(out).select("key", "attempt", kind.alias("kind"), "error").withColumn("at", F.current_timestamp()), path)
        finally:
            out.unpersist()

    writer = transitions(events, **options).writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if interval else drained(writer)


def items(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, status, retry_count, attempt, created_at, updated_at, error_message, payload: what the queue holds at its last committed batch."""

    def read(name: str) -> DataFrame:
        state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
        value = "value.value" if "value" in state.schema["value"].dataType.fieldNames() else "value"
        return state.select(F.col("key.key").alias("key"), f"{value}.*")

    both = read("item").unionByName(read("failed"))
    return both.select("key", "status", "retry_count", "attempt", F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("updated_us").alias("updated_at"), F.col("error").alias("error_message"), "payload")
