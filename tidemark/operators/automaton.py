"""Ordered folds of finite machines by composition, so that one key's events spread over many tasks.

An event is a function from states to states that also adds to counters; what a run of events does is the composition of theirs,
again such a function. Runs of a key are cut into blocks by their sequence numbers, blocks into blocks of blocks, up
to one for each key: a task meets `size` events or blocks of a key at once, however many the key has. Downwards, each
block learns from those before it in which state it begins, and its rows can then be worked out by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1024


@dataclass(frozen=True)
class Machine:
    """Effects of the event codes 0, 1, ..., each a row of (next state, count, failures, resets) for every state.

    `count` adds up. `failures` adds up since the last event that resets, whose own failures are the first of the new sum.
    """

    effects: Sequence[Sequence[tuple[int, int, int, bool]]]

    @property
    def states(self) -> range:
        return range(len(self.effects[0]))

    def effect(self, code: Column) -> Column:
        """What the event of a code does: an array with an entry for each state."""
        every = F.array(*[F.array(*[_entry(*e) for e in effect]) for effect in self.effects])
        return F.element_at(every, code + 1)

    def nothing(self) -> Column:
        """The effect of no event."""
        return F.array(*[_entry(q, 0, 0, False) for q in self.states])


def _entry(to: int, count: int, failures: int, resets: bool) -> Column:
    return F.struct(F.lit(to).alias("to"), F.lit(count).cast("long").alias("count"), F.lit(failures).cast("long").alias("failures"), F.lit(resets).alias("resets"))


def step(entry: Column, effect: Column) -> Column:
    """An entry once an effect follows it."""
    new = F.element_at(effect, entry["to"] + 1)
    failures = F.when(new["resets"], new["failures"]).otherwise(entry["failures"] + new["failures"])
    return F.struct(new["to"].alias("to"), (entry["count"] + new["count"]).alias("count"), failures.alias("failures"), (entry["resets"] | new["resets"]).alias("resets"))


def then(first: Column, second: Column) -> Column:
    """The effect of two runs, one after the other; associative."""
    return F.transform(first, lambda entry: step(entry, second))


def _levels(events: DataFrame, size: int) -> int:
    low, high = events.agg(F.min("seq"), F.max("seq")).first()
    levels, span = 1, 0 if low is None else max(high // size, -(low // size)) + 1
    while span > 1:
        levels, span = levels + 1, -(-span // size)
    return levels


def block_of(number: Column, size: int) -> Column:
    """number over size, rounded down for negative numbers too."""
    return F.floor((number - F.pmod(number, F.lit(size))) / F.lit(size)).cast("long")


def summaries(events: DataFrame, machine: Machine, size: int = SIZE) -> list[DataFrame]:
    """(key, block, effect) by level, of events(key, seq, code); block n of a level takes in the blocks floor(m / size) = n below it.

    Null keys are a key. Sequence numbers differ within a key.
    """
    run = F.array_sort(F.collect_list(F.struct("seq", "code")))
    levels = [events.groupBy("key", block_of(F.col("seq"), size).alias("block")).agg(F.aggregate(run, machine.nothing(), lambda held, e: then(held, machine.effect(e["code"]))).alias("effect"))]
    for _ in range(_levels(events, size) - 1):
        below = F.array_sort(F.collect_list(F.struct("block", "effect")))
        up = levels[-1].groupBy("key", block_of(F.col("block"), size).alias("up")).agg(F.aggregate(below, machine.nothing(), lambda held, b: then(held, b["effect"])).alias("effect"))
        levels.append(up.withColumnRenamed("up", "block"))
    return levels


def _whole(top: DataFrame, machine: Machine) -> DataFrame:
    """The top level may hold a block below zero and one from zero on."""
    both = F.array_sort(F.collect_list(F.struct("block", "effect")))
    return top.groupBy("key").agg(F.aggregate(both, machine.nothing(), lambda held, b: then(held, b["effect"])).alias("effect"))


def final(events: DataFrame, machine: Machine, start: int, size: int = SIZE) -> DataFrame:
    """(key, state, count, failures) after all events of each key, every key beginning in the state `start`."""
    entry = F.element_at("effect", start + 1)
    return _whole(summaries(events, machine, size)[-1], machine).select("key", entry["to"].alias("state"), entry["count"].alias("count"), entry["failures"].alias("failures"))


def starts(events: DataFrame, machine: Machine, start: int, size: int = SIZE) -> DataFrame:
    """(key, block, state, count, failures) with which each block of `size` sequence numbers begins."""
    levels = summaries(events, machine, size)
    begin = _entry(start, 0, 0, False)
    at = _unfolded(levels[-1].withColumn("up", F.lit(0).cast("long")).withColumn("begin", begin))
    for level in reversed(levels[:-1]):
        held = at.select(F.col("key").alias("of"), F.col("block").alias("up"), "begin")
        rows = level.withColumn("up", block_of(F.col("block"), size))
        rows = rows.join(held, F.col("key").eqNullSafe(F.col("of")) & (rows["up"] == held["up"])).select("key", "block", "effect", rows["up"], "begin")
        at = _unfolded(rows)
    return at.select("key", "block", F.col("begin")["to"].alias("state"), F.col("begin")["count"].alias("count"), F.col("begin")["failures"].alias("failures"))


def _unfolded(rows: DataFrame) -> DataFrame:
    """(key, block, begin) of blocks(key, up, block, effect, begin), begin being the state at the first block of each up."""
    run = F.array_sort(F.collect_list(F.struct("block", "effect")))
    told = F.array().cast("array<struct<block:bigint,begin:struct<to:int,count:bigint,failures:bigint,resets:boolean>>>")
    walk: Callable[[Column, Column], Column] = lambda held, b: F.struct(
        step(held["now"], b["effect"]).alias("now"), F.array_append(held["told"], F.struct(b["block"].alias("block"), held["now"].alias("begin"))).alias("told")
    )
    walked = rows.groupBy("key", "up").agg(F.aggregate(run, F.struct(F.first("begin").alias("now"), told.alias("told")), walk).alias("walked"))
    return walked.select("key", F.explode("walked.told").alias("b")).select("key", "b.block", "b.begin")
