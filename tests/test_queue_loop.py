"""The queue's keyed state against the same events folded one by one, and its timers."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.workqueue import MAX_RETRIES
from tidemark.streaming import queue_loop as ql


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def run(spark, events, folder, batches, **options):
    """The changed rows by batch, each batch being one file."""
    schema = "url string, host_id string, seq long, kind string, at timestamp"
    for n in range(batches):
        spark.createDataFrame([e for e in events if e[5] == n], f"{schema}, batch long").drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ql.needs_rocks(spark)
    out = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    told = ql.queue_loop(source, by_event_time=True, **options)
    query = told.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    query.foreachBatch(lambda df, n: out.append([tuple(r) for r in df.select("url", "host_id", "opened", "status", "retry_count", F.unix_micros("created_at"), F.unix_micros("updated_at"), "ready").collect()])).start().awaitTermination()
    return out


def second(n):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def folded(events):
    """(key, opened) -> (status, retries) after all events and the clock's last time, worked out from the rules again."""
    last = max(e[4] for e in events)
    out = {}
    for key in {e[:2] for e in events}:
        row = None
        for _, _, seq, kind, at, _ in sorted((e for e in events if e[:2] == key), key=lambda e: (e[4], e[2])):
            if row and row["status"] == "processing" and (at - row["at"]).total_seconds() > 120:
                row["status"] = "pending"
            active = row is not None and row["status"] in ("pending", "processing")
            if kind == "enqueue" and not active:
                row = out[(key, seq)] = {"status": "pending", "retries": 0, "at": at}
            elif row and kind == "start" and (row["status"] == "pending" or row["status"] == "failed" and row["retries"] < MAX_RETRIES):
                row.update(status="processing", at=at)
            elif active and kind == "ok":
                row.update(status="done", at=at)
            elif active and kind == "fail":
                row.update(status="failed", retries=row["retries"] + 1, at=at)
        if row and row["status"] == "processing" and (last - row["at"]).total_seconds() > 120:
            row["status"] = "pending"
    return {k: (r["status"], r["retries"]) for k, r in out.items()}


def test_stream_equals_the_fold(spark, folder):
    rng = random.Random(5)
    events, now = [], 0
    for seq in range(600):
        now += rng.choice([1, 5, 30, 90])
        kind = rng.choice(["enqueue", "start", "start", "ok", "fail", "fail", "noise"])
        events.append((f"u{rng.randrange(12)}", rng.choice(["h1", "h2"]), seq, kind, second(now), seq // 200))
    got = {}
    for batch in run(spark, events, folder, 3):
        for url, host, opened, status, retries, *_ in batch:
            got[((url, host), opened)] = (status, retries)
    assert got == folded(events)
    assert {s for s, _ in got.values()} == {"pending", "done", "failed", "processing"} or len(got) > 50
    assert max(r for _, r in got.values()) == MAX_RETRIES


def test_stale_rows_return_without_an_event_of_their_key(spark, folder):
    events = [("a", "h", 1, "enqueue", second(0), 0), ("a", "h", 2, "start", second(10), 0), ("b", "h", 3, "enqueue", second(20), 0), ("c", "h", 4, "enqueue", second(131), 1), ("c", "h", 5, "start", second(140), 1)]
    batches = run(spark, events, folder, 2)
    assert ("a", "h", 1, "processing", 0) in [r[:5] for r in batches[0]]
    later = [r for b in batches[1:] for r in b if r[0] == "a"]
    base = 1704067200 * 10**6
    assert later == [("a", "h", 1, "pending", 0, base, base + 130 * 10**6, True)]  # 120 s after it started, by the timer alone
    assert [r[3] for b in batches for r in b if r[0] == "b"] == ["pending"] and [r[3] for b in batches for r in b if r[0] == "c"] == ["processing"]


def test_rows_that_end_leave_no_state(spark, folder):
    """A key whose row is done or failed for good starts anew: its next enqueue has no retries."""
    kinds = ["enqueue", "start", "ok", "ok", "fail", "start", "enqueue", "fail", "start", "fail", "start", "fail", "start", "ok", "enqueue"]
    events = [("a", None, seq, kind, second(seq), 0 if seq < 8 else 1) for seq, kind in enumerate(kinds)]
    last = {r[2]: r[3:5] for b in run(spark, events, folder, 2) for r in b}
    assert last == {0: ("done", 0), 6: ("failed", 3), 14: ("pending", 0)}


def test_moves():
    turn = ql.moved(None, 7, "enqueue", 100)
    assert turn.ready and ql.moved(turn, 8, "enqueue", 101) is turn and ql.moved(None, 8, "ok", 101) is None
    busy = ql.moved(turn, 9, "start", 102)
    assert not busy.ready and ql.moved(busy, 9, "start", 103) is busy
    late = ql.moved(busy, 10, "noise", 103 + ql.STALE_MICROS)
    assert late.status == "pending" and late.updated == 102 + ql.STALE_MICROS and ql.moved(late, 11, "ok", late.updated + 1).over
