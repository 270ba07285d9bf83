"""The scan queue's loop as keyed state with timers.

Each (url, host) is a key whose state is its open row alone: status, retries and times. Offers open a row, claims move
it to processing, outcomes end it or count a retry; a timer returns a row that is in processing for too long
to the pending ones, with or without further events of its key. A row that is done, or failed for good, leaves no state,
so that the state grows with the open work. What changes is given out as it changes, `ready` marking the rows that
workers may claim; how many are claimed at once is up to those who read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.workqueue import MAX_RETRIES

STALE_MICROS = 120_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN = "opened long, status string, retry_count int, created long, updated long, timer long"


class Turn(NamedTuple):
    """An open row; times in microseconds, timer in milliseconds where one is set."""

    opened: int
    status: str
    retry_count: int
    created: int
    updated: int
    timer: int | None = None

    @property
    def ready(self) -> bool:
        return self.status == "pending" or (self.status == "failed" and self.retry_count < MAX_RETRIES)

    @property
    def over(self) -> bool:
        return self.status == "done" or (self.status == "failed" and self.retry_count >= MAX_RETRIES)


def recovered(turn: Turn | None, at: int) -> Turn | None:
    """The row at a time: pending from the moment when its time in processing was up."""
    if turn and turn.status == "processing" and at > turn.updated + STALE_MICROS:
        return turn._replace(status="pending", updated=turn.updated + STALE_MICROS)
    return turn


def moved(turn: Turn | None, seq: int, kind: str, at: int) -> Turn | None:
    """The row after an event; the same object where the event changes nothing.

    An enqueue opens a row unless one is pending or processing; only ready rows start; outcomes count for pending rows
    too, as a scan may end after its row was recovered.
    """
    turn = recovered(turn, at)
    if kind == "enqueue" and (turn is None or turn.status in ("done", "failed")):
        return Turn(seq, "pending", 0, at, at)
    if turn is None:
        return None
    if kind == "start" and turn.ready:
        return turn._replace(status="processing", updated=at)
    if kind == "ok" and turn.status in ("pending", "processing"):
        return turn._replace(status="done", updated=at)
    if kind == "fail" and turn.status in ("pending", "processing"):
        return turn._replace(status="failed", retry_count=turn.retry_count + 1, updated=at)
    return turn


class QueueLoop(StatefulProcessor):
    """Folds events(seq, kind, at_us) of a key; the rows of one batch and key are sorted in memory, which the size of a batch bounds."""

    def __init__(self, keys: list[str], by_event_time: bool):
        self.keys, self.by_event_time = keys, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _told(self, key: tuple, turn: Turn) -> Row:
        held = dict(zip(self.keys, key, strict=True))
        return Row(**held, opened=turn.opened, status=turn.status, retry_count=turn.retry_count, created=turn.created, updated=turn.updated, ready=turn.ready)

    def _keep(self, before: Turn | None, now: Turn | None, clock_ms: int) -> None:
        if before and before.timer is not None:
            self.handle.deleteTimer(before.timer)
        if now is None or now.over:
            if before:
                self.open.clear()
            return
        timer = None
        if now.status == "processing":
            timer = (now.updated + STALE_MICROS) // 1000 + 1 if self.by_event_time else clock_ms + STALE_MICROS // 1000
            self.handle.registerTimer(timer)
        self.open.update(tuple(now._replace(timer=timer)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before = Turn(*self.open.get()) if self.open.exists() else None
        turn, changed = before, {}
        for row in sorted(rows, key=lambda r: (r["at_us"], r["seq"])):
            new = moved(turn, row["seq"], row["kind"], row["at_us"])
            if new is not turn:
                changed[new.opened] = turn = new
        if changed:
            self._keep(before, turn, timerValues.getCurrentProcessingTimeInMs())
        for opened in sorted(changed):
            yield self._told(tuple(key), changed[opened])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if not self.open.exists():
            return
        turn = Turn(*self.open.get())
        if turn.status == "processing" and turn.timer == expiredTimerInfo.getExpiryTimeInMs():
            at = turn.updated + STALE_MICROS if self.by_event_time else turn.timer * 1000
            turn = turn._replace(status="pending", updated=at, timer=None)
            self.open.update(tuple(turn))
            yield self._told(tuple(key), turn)


def needs_rocks(spark: SparkSession) -> None:
    """State of this kind is kept by RocksDB; set where the session has another store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def queue_loop(events: DataFrame, keys: tuple[str, ...] = ("url", "host_id"), by_event_time: bool = False, delay: str = "0 seconds") -> DataFrame:
    """The stream of changed rows (keys, opened, status, retry_count, created_at, updated_at, ready) of a stream of events(keys, seq, kind, at).

    kind is enqueue, start, ok or fail; others change nothing. opened, the seq of the enqueue that opened it, names a row
    of its key; a batch gives each changed row once, as it is after the batch. Stale rows are recovered by the clock, or by
    the watermark of `at`, which then lags by `delay`: that repeats whenever the stream is replayed. Null keys are a key.
    """
    at = F.col("at").cast("timestamp")
    rows = events.filter(F.col("kind").isin("enqueue", "start", "ok", "fail")).select(*keys, F.col("seq").cast("long").alias("seq"), "kind", at.alias("at"), F.unix_micros(at).alias("at_us"))
    rows = rows.withWatermark("at", delay) if by_event_time else rows
    kinds = dict(events.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", opened long, status string, retry_count int, created long, updated long, ready boolean"
    told = rows.groupBy(*keys).transformWithState(QueueLoop(list(keys), by_event_time), out, "Update", "EventTime" if by_event_time else "ProcessingTime")
    return told.select(*keys, "opened", "status", "retry_count", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("updated").alias("updated_at"), "ready")
