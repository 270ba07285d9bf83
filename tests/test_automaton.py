"""Folds by composition against the windows over whole keys, and how they spread."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import automaton, lifecycle, workqueue

KINDS = ["alive", "unreachable", "seed_alive", "seed_dead", "seed_unreachable", "ok", "fail", "dns_ok", "dns_fail", "certificate", "noise"]


def log(seed, n, keys):
    """Random events; sequence numbers leave gaps, begin below zero and differ within a key only."""
    rng, at = random.Random(seed), {}
    rows = []
    for _ in range(n):
        key = rng.choice(keys)
        at[key] = at.get(key, rng.randint(-60, 5)) + rng.choice([1, 1, 1, 2, 9])
        rows.append((key, at[key], rng.choice(KINDS), rng.choice(["web", "other", "unknown", None]), rng.choice([True, False, None])))
    return rows


@pytest.mark.parametrize("size", [6, 1024])
def test_lifecycles(spark, size):
    events = spark.createDataFrame(log(size, 400, [1, 2, 2, 2, 2, 3, None]), "key long, seq long, kind string, type string, answered boolean")
    lived = lifecycle.lifecycle(events)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(lifecycle.final_states(events, size)) == rows(lifecycle.current(lived).select("key", "status", "type", "newly_dead"))
    assert rows(lifecycle.lifecycle_in_blocks(events, size).select(*lived.columns)) == rows(lived)


@pytest.mark.parametrize("size", [6, 1024])
def test_admission(spark, size):
    rng = random.Random(size)
    rows = [(k, s, rng.choice(["enqueue", "start", "ok", "fail", "other"])) for k, s, *_ in log(size, 300, [1, 1, 1, 2, None])]
    events = spark.createDataFrame(rows, "key long, seq long, kind string").withColumn("at", F.timestamp_seconds(F.col("seq") + 1000))
    whole, parts = workqueue.admit(events), workqueue.admit_in_blocks(events, size)
    got = lambda df: sorted(map(str, df.select("key", "seq", "kind", "segment", "admitted", "retries").collect()))
    assert got(parts) == got(whole)
    told = lambda df: sorted(map(str, df.select("key", "row", "status", "retry_count", "created_at", "updated_at").collect()))
    assert told(workqueue.replay_in_blocks(events, size)) == told(workqueue.replay(events))


def test_composition_is_associative(spark):
    machine = workqueue.ADMISSION
    rows = [(a, b, c) for a in range(5) for b in range(5) for c in range(5)]
    f, g, h = (machine.effect(F.col(c)) for c in "abc")
    df = spark.createDataFrame(rows, "a int, b int, c int").select(automaton.then(automaton.then(f, g), h).alias("left"), automaton.then(f, automaton.then(g, h)).alias("right"), automaton.then(machine.nothing(), f).alias("same"), f.alias("f"))
    assert df.filter("left <> right or same <> f").count() == 0


def test_no_events(spark):
    none = spark.createDataFrame([], "key long, seq long, kind string, type string, answered boolean, at timestamp")
    assert lifecycle.final_states(none).count() == lifecycle.lifecycle_in_blocks(none).count() == workqueue.replay_in_blocks(none).count() == 0


def test_one_hot_host_spreads(spark):
    """A host with 200,000 events: no task collects or orders more than a block of them."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("alive", "fail", "dns_ok", "ok")]), (F.xxhash64("id") % 2 + F.col("id") % 2 + 2).cast("int"))
    events = spark.range(200_000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("seq"), kind.alias("kind"), F.when(F.col("id") % 5 == 0, "other").otherwise("web").alias("type"), (F.col("id") % 3 == 0).alias("answered"))
    levels = automaton.summaries(lifecycle._codes(events), lifecycle.LIFE)
    assert [level.count() for level in levels] == [196, 1]
    (row,) = lifecycle.final_states(events).collect()
    assert row["newly_dead"] == lifecycle.current(lifecycle.lifecycle(events)).first()["newly_dead"] > 1000
    plan = lifecycle.lifecycle_in_blocks(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") >= 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
