"""The scan queue as set operations: admission, claims, outcomes and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .automaton import SIZE, Machine, block_of, starts

ACTIVE = ("pending", "processing")
MAX_RETRIES = 3
STALE = "INTERVAL 2 MINUTES"


def enqueue(offers: DataFrame, queue: DataFrame, as_of: Column) -> DataFrame:
    """Queue rows for offers(seq, url, host_id, source) whose key is not active yet; the first offer of a key wins.

    The time is part of an id, as seq may start anew in a later batch.
    """
    active = queue.filter(F.col("status").isin(*ACTIVE)).select("url", "host_id")
    first = offers.join(active, ["url", "host_id"], "left_anti").groupBy("url", "host_id").agg(F.min_by("source", "seq").alias("source"), F.min("seq").alias("seq"))
    return first.select(
        S.stable_id("url", "host_id", "seq", F.unix_micros(as_of)).alias("id"), "host_id", "url", "source", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), as_of.alias("created_at"), as_of.alias("updated_at")
    )


def claim(queue: DataFrame, workers: int, as_of: Column) -> DataFrame:
    """The queue after up to `workers` claims: the oldest eligible rows become processing.

    Eligible are pending rows and failed ones with retries left, at most one of a key, and none whose key is
    being processed.
    """
    key = Window.partitionBy("url", "host_id").orderBy("created_at", "id")
    busy = queue.filter("status = 'processing'").select("url", "host_id").distinct()
    eligible = queue.filter((F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("retry_count") < MAX_RETRIES)))
    picked = eligible.join(busy, ["url", "host_id"], "left_anti").withColumn("n", F.row_number().over(key)).filter("n = 1").orderBy("created_at", "id").limit(workers)
    taken = queue.join(picked.select("id", F.lit(True).alias("taken")), "id", "left")
    return taken.withColumn("status", F.when(F.col("taken"), "processing").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("taken"), as_of).otherwise(F.col("updated_at"))).drop("taken")


def settle(queue: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The queue after outcomes(id, outcome): ok ends a row, fail counts a retry."""
    ended = queue.join(outcomes.select("id", "outcome"), "id", "left")
    return (
        ended.withColumn("status", F.when(F.col("outcome") == "ok", "done").when(F.col("outcome") == "fail", "failed").otherwise(F.col("status")))
        .withColumn("retry_count", F.col("retry_count") + F.when(F.col("outcome") == "fail", 1).otherwise(0))
        .withColumn("updated_at", F.when(F.col("outcome").isNotNull(), as_of).otherwise(F.col("updated_at")))
        .drop("outcome")
    )


def recover(queue: DataFrame, as_of: Column) -> DataFrame:
    """Rows in processing for over two minutes become pending again; retries stay."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < as_of - F.expr(STALE))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status"))).withColumn("updated_at", F.when(stale, as_of).otherwise(F.col("updated_at")))


def depth(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def admit(events: DataFrame) -> DataFrame:
    """events(key, seq, kind) with `segment`, `admitted` and `retries`: replay of enqueue, start, ok and fail.

    A segment ends with ok or fail; an enqueue is admitted if its segment holds no enqueue or start before it.
    retries counts the failures since the last admission, up to and with the row.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("kind").isin("ok", "fail").cast("int")
    out = events.withColumn("segment", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    within = Window.partitionBy("key", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    busy = F.coalesce(F.sum(F.col("kind").isin("enqueue", "start").cast("int")).over(within), F.lit(0))
    out = out.withColumn("admitted", (F.col("kind") == "enqueue") & (busy == 0))
    out = out.withColumn("era", F.sum(F.col("admitted").cast("int")).over(upto))
    since = Window.partitionBy("key", "era").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("retries", F.sum((F.col("kind") == "fail").cast("int")).over(since)).drop("era")


#: States: idle, busy. Codes: enqueue, start, ok, fail, anything else. Counts are admissions, which start the failures anew.
ADMISSION = Machine(
    [
        [(1, 1, 0, True), (1, 0, 0, False)],
        [(1, 0, 0, False), (1, 0, 0, False)],
        [(0, 0, 0, False), (0, 0, 0, False)],
        [(0, 0, 1, False), (0, 0, 1, False)],
        [(0, 0, 0, False), (1, 0, 0, False)],
    ]
)


def _codes(events: DataFrame) -> DataFrame:
    kind = F.col("kind")
    code = F.when(kind == "enqueue", 0).when(kind == "start", 1).when(kind == "ok", 2).when(kind == "fail", 3).otherwise(4)
    return events.select("key", F.col("seq").cast("long").alias("seq"), code.alias("code"))


def _with_starts(events: DataFrame, size: int) -> DataFrame:
    """events with their block and the state, admissions and failures with which it begins."""
    began = starts(_codes(events), ADMISSION, 0, size).select(F.col("key").alias("begin_key"), F.col("block").alias("begin_block"), "state", F.col("count").alias("admissions"), "failures")
    rows = events.withColumn("block", block_of(F.col("seq").cast("long"), size))
    return rows.join(began, F.col("key").eqNullSafe(F.col("begin_key")) & (F.col("block") == F.col("begin_block"))).drop("begin_key", "begin_block")


def admit_in_blocks(events: DataFrame, size: int = SIZE) -> DataFrame:
    """`admit`, with windows over blocks of `size` sequence numbers instead of whole keys: a hot key spreads over tasks.

    A block begins busy or not, and with the failures since the last admission, as the blocks before it leave it.
    """
    known = _with_starts(events, size)
    ends = F.col("kind").isin("ok", "fail").cast("int")
    sums = events.groupBy(F.col("key").alias("begin_key"), block_of(F.col("seq").cast("long"), size).alias("begin_block")).agg(F.sum(ends).alias("ended"))
    blocks = Window.partitionBy("begin_key").orderBy("begin_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("begin_key", "begin_block", F.coalesce(F.sum("ended").over(blocks), F.lit(0)).alias("earlier"))
    rows = known.join(earlier, F.col("key").eqNullSafe(F.col("begin_key")) & (F.col("block") == F.col("begin_block"))).drop("begin_key", "begin_block")
    order = Window.partitionBy("key", "block").orderBy("seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    within = Window.partitionBy("key", "block", "own").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    busy = F.coalesce(F.sum(F.col("kind").isin("enqueue", "start").cast("int")).over(within), F.lit(0)) + F.when(F.col("own") == 0, F.col("state")).otherwise(0)
    rows = rows.withColumn("admitted", (F.col("kind") == "enqueue") & (busy == 0))
    rows = rows.withColumn("era", F.sum(F.col("admitted").cast("int")).over(upto))
    since = Window.partitionBy("key", "block", "era").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    retries = F.sum((F.col("kind") == "fail").cast("int")).over(since) + F.when(F.col("era") == 0, F.col("failures")).otherwise(0)
    return rows.withColumns({"segment": F.col("own") + F.col("earlier"), "retries": retries, "row": F.col("era") + F.col("admissions")}).drop("own", "earlier", "era", "state", "admissions", "failures", "block")


def busy_after(events: DataFrame) -> DataFrame:
    """(key, busy) after events(key, seq, kind): whether an enqueue or a start came after the last ok or fail."""
    begin, end = (F.max(F.when(F.col("kind").isin(*kinds), F.col("seq"))) for kinds in (("enqueue", "start"), ("ok", "fail")))
    return events.groupBy("key").agg(begin.alias("begin"), end.alias("end")).select("key", F.coalesce(F.col("begin") > F.coalesce("end", F.lit(-(1 << 63))), F.lit(False)).alias("busy"))


def admit_after(busy: DataFrame | None, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, seq) of the admitted enqueues of events(key, seq, kind), and which keys are busy after them.

    busy(key, busy) says which keys were busy before; their work counts as started before all events.
    """
    every = events.select("key", "seq", "kind")
    if busy is not None:
        every = busy.filter("busy").select("key", F.lit(-(1 << 62)).alias("seq"), F.lit("start").alias("kind")).unionByName(every)
    return admit(every).filter("admitted").select("key", "seq"), busy_after(every)


def replay(events: DataFrame) -> DataFrame:
    """Current queue rows (key, url, host_id, status, retry_count, created_at, updated_at) after events(key, seq, kind, at).

    A row starts with each admitted enqueue; start, ok and fail move it on.
    """
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return _rows_of(admit(events).withColumn("row", F.sum(F.col("admitted").cast("int")).over(upto)))


def replay_in_blocks(events: DataFrame, size: int = SIZE) -> DataFrame:
    """`replay`, a hot key's events being spread over tasks; the numbers of its rows go on from block to block."""
    return _rows_of(admit_in_blocks(events, size))


def _rows_of(told: DataFrame) -> DataFrame:
    """Queue rows of admitted events with the number of their row."""
    moved = F.when(F.col("admitted"), "pending").when(F.col("kind") == "start", "processing").when(F.col("kind") == "ok", "done").when(F.col("kind") == "fail", "failed")
    told = told.filter("row > 0").withColumn("moved", moved).filter("moved is not null")
    return told.groupBy("key", "row").agg(
        F.max_by("moved", "seq").alias("status"), F.count_if(F.col("kind") == "fail").cast("int").alias("retry_count"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
    )
