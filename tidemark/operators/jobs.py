"""Scan jobs: admission, failure sync and completion statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ACTIVE = 10
EXTERNAL_FAILURES = ("failed", "canceled", "internal_error")
COUNTS = ("new_hosts", "newly_dead", "new_services")


def active_jobs(jobs: DataFrame, external_only: bool = False) -> DataFrame:
    found = jobs.filter(F.col("status").isin("pending", "running"))
    return found.filter("external_id is not null") if external_only else found


def idle_patterns(patterns: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active patterns without an active job."""
    return patterns.filter("active").join(active_jobs(jobs).select(F.col("pattern_id").alias("id")), "id", "left_anti")


def admit_launches(patterns: DataFrame, jobs: DataFrame, limit: int = MAX_ACTIVE) -> DataFrame:
    """Idle patterns to launch, oldest first, as far as the limit of active jobs allows.

    The rank runs over patterns alone, of which only the first `limit` are ever needed.
    """
    room = active_jobs(jobs).agg(F.greatest(F.lit(limit) - F.count(F.lit(1)), F.lit(0)).alias("room"))
    first = idle_patterns(patterns, jobs).orderBy("created_at", "id").limit(limit)
    ranked = first.withColumn("place", F.row_number().over(Window.orderBy("created_at", "id")))
    return ranked.join(F.broadcast(room), F.col("place") <= F.col("room")).drop("room")


def launch_tally(admitted: DataFrame) -> DataFrame:
    """One row: how many launches were admitted."""
    return admitted.agg(F.count(F.lit(1)).alias("launched"))


def failed_outside(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """(job_id, status): failure events for active jobs whose state in states(external_id, state) is a failure."""
    bad = states.filter(F.col("state").isin(*EXTERNAL_FAILURES)).select("external_id")
    return active_jobs(jobs, True).join(bad, "external_id").select(F.col("id").alias("job_id"), F.lit("failed").alias("status"))


def completion_stats(jobs: DataFrame, hosts: DataFrame, services: DataFrame, mode: str = "exact") -> DataFrame:
    """(job_id, new_hosts, newly_dead, new_services) of every job.

    Counts what came about since the job's start: hosts created, hosts that are dead and were updated, services
    created. `exact` counts each once; `parity` counts a host once for each of its new services, as a plain
    join of the three tables does. Jobs without a start have zeros.
    """
    if mode not in ("exact", "parity"):
        raise ValueError(f"mode must be exact or parity, not {mode!r}")
    hosts = hosts.select(F.col("id").alias("host_id"), "pattern_id", "status", F.col("created_at").alias("made"), F.col("updated_at").alias("updated"))
    services = services.select("host_id", F.col("created_at").alias("served")).filter("served is not null")
    placed = services.join(hosts, "host_id")
    dead = F.col("status") == "dead"
    if mode == "exact":
        new_hosts = hosts.select("pattern_id", F.col("made").alias("at"), *_steps("new_hosts", F.lit(1)))
        newly_dead = hosts.filter(dead).select("pattern_id", F.col("updated").alias("at"), *_steps("newly_dead", F.lit(1)))
        moved = new_hosts.unionByName(newly_dead)
    else:
        # a host counts once while it has no new service, and else once for each: its newest service is told apart
        last = F.max("served").alias("last")
        lone = hosts.join(services.groupBy("host_id").agg(last), "host_id", "left")
        moved = None
        for name, held, at in (("new_hosts", F.lit(True), "made"), ("newly_dead", dead, "updated")):
            # one for the host from its own time on; where it has services, one less up to its last one, made up by each of them
            known = lone.filter(F.col(at).isNotNull())
            each = [
                known.filter(held).select("pattern_id", F.col(at).alias("at"), *_steps(name, F.lit(1))),
                known.filter(held & F.col("last").isNotNull()).select("pattern_id", F.least(at, "last").alias("at"), *_steps(name, F.lit(-1))),
                placed.filter(held & F.col(at).isNotNull()).select("pattern_id", F.least(at, "served").alias("at"), *_steps(name, F.lit(1))),
            ]
            for part in each:
                moved = part if moved is None else moved.unionByName(part)
    moved = moved.unionByName(placed.select("pattern_id", F.col("served").alias("at"), *_steps("new_services", F.lit(1))))
    started = jobs.select(F.col("id").alias("job_id"), "pattern_id", "started_at")
    counts = since(moved, started.filter("started_at is not null").select("pattern_id", F.col("started_at").alias("at")).distinct())
    joined = started.join(counts.withColumnRenamed("at", "started_at"), ["pattern_id", "started_at"], "left")
    return joined.select("job_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def _steps(name: str, by: Column) -> list[Column]:
    return [(by if c == name else F.lit(0)).cast("long").alias(c) for c in COUNTS]


def since(changes: DataFrame, starts: DataFrame) -> DataFrame:
    """(pattern_id, at, counts) of starts(pattern_id, at): the sums of changes(pattern_id, at, counts) of each pattern from that time on.

    Changes and starts are summed by pattern and time first, so that only distinct times are left of either; a sum that
    runs from the newest day back then meets one that runs from the newest time of each day, so that a
    pattern that holds everything is dealt out by its days. No start meets a change row by row.
    """
    day = F.date_trunc("day", "at").alias("day")
    times = changes.groupBy("pattern_id", "at").agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumn("asked", F.lit(False))
    times = times.unionByName(starts.select("pattern_id", "at", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(True).alias("asked"))).withColumn("day", day)
    days = times.groupBy("pattern_id", "day").agg(*[F.sum(c).alias(c) for c in COUNTS])
    newer = Window.partitionBy("pattern_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    later = days.select("pattern_id", "day", *[F.coalesce(F.sum(c).over(newer), F.lit(0)).alias(f"later_{c}") for c in COUNTS])
    # changes of the very time of a start count too
    within = Window.partitionBy("pattern_id", "day").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = times.select("pattern_id", "day", "at", "asked", *[F.sum(c).over(within).alias(c) for c in COUNTS]).filter("asked")
    return told.join(later, ["pattern_id", "day"]).select("pattern_id", "at", *[(F.col(c) + F.col(f"later_{c}")).alias(c) for c in COUNTS])


def job_digests(jobs: DataFrame, stats: DataFrame, as_of: Column) -> DataFrame:
    """Digest rows of completed jobs: one pattern each, its counts and the seconds since its start."""
    done = jobs.filter("status = 'completed'").select(F.col("id").alias("job_id"), "started_at")
    seconds = F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp(F.col("started_at").cast("timestamp")), F.lit(0))
    return done.join(stats, "job_id").select("job_id", F.lit(1).cast("long").alias("patterns"), "new_hosts", "newly_dead", "new_services", seconds.alias("duration_seconds"))
