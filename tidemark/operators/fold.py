"""Keyed folds of ordered records into current-state tables, each column keeping its first or last value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

HOST_FIRST, HOST_LAST = ("id", "pattern_id", "created_at"), ("ip", "cdn", "status", "type", "dns", "ports", "last_seen_at")
SERVICE_FIRST, SERVICE_LAST = ("id", "host_id", "created_at"), ("chain", "technologies", "cookies", "metadata", "external_hosts", "scanned_at")


def upsert(old: DataFrame | None, new: DataFrame, key: str, first: tuple[str, ...], last: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """One row per key of old and new: `first` columns of its earliest record, `last` columns of its latest.

    old rows come before all of new; nulls are values like any other. One shuffle on the key, partial
    aggregates before it. Write the result to a new path, never over old.
    """
    columns = [key, *first, *last]
    rows = new.select(*columns, F.col(seq).cast("long").alias("__seq"))
    if old is not None:
        rows = old.select(*columns, F.lit(-(1 << 62)).alias("__seq")).unionByName(rows)
    folded = rows.groupBy(key).agg(F.min_by(F.struct(*first), "__seq").alias("first"), F.max_by(F.struct(*last), "__seq").alias("last"), F.max("__seq").alias("seq"))
    return folded.select(key, "first.*", "last.*", "seq")


def observed_hosts(observations: DataFrame) -> DataFrame:
    """Host records of observations(seq, pattern_id, fqdn, ip, cdn, dns, ports, observed_at).

    The status comes from the raw address, the type from the ports; only an alive host has been seen.
    """
    status = S.host_status("ip")
    return observations.select(
        "seq", "fqdn", S.stable_id("fqdn").alias("id"), "pattern_id", S.valid_ip("ip").alias("ip"), "cdn", status.alias("status"), S.host_type("ports").alias("type"), "dns", "ports",
        F.when(status == "alive", F.col("observed_at")).alias("last_seen_at"), F.col("observed_at").alias("created_at"),
    )


def upsert_hosts(old: DataFrame | None, observations: DataFrame) -> DataFrame:
    return upsert(old, observed_hosts(observations), "fqdn", HOST_FIRST, HOST_LAST)


def upsert_services(old: DataFrame | None, results: DataFrame) -> DataFrame:
    return upsert(old, results, "url", SERVICE_FIRST, SERVICE_LAST)


def insert_patterns(patterns: DataFrame, requests: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """inserted, conflict and invalid rows of requests(seq, value): only valid values that are not known yet are inserted."""
    judged = requests.withColumn("valid", S.valid_pattern("value"))
    rank = F.row_number().over(Window.partitionBy("value").orderBy("seq"))
    valid = judged.filter("valid").withColumn("n", rank).join(patterns.select("value", F.lit(True).alias("known")), "value", "left")
    fresh = F.col("known").isNull() & (F.col("n") == 1)
    inserted = valid.filter(fresh).select(S.stable_id("value").alias("id"), "value", F.lit(True).alias("active"), as_of.alias("created_at"))
    return {"inserted": inserted, "conflicts": valid.filter(~fresh).select("seq", "value"), "invalid": judged.filter(~F.col("valid")).select("seq", "value")}


def delete_patterns(ids: DataFrame, hosts: DataFrame, services: DataFrame, queue: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """What is left of the tables once the patterns of ids(id) and all that hangs on them are gone."""
    gone = hosts.join(ids.select(F.col("id").alias("pattern_id")), "pattern_id", "left_semi").select(F.col("id").alias("host_id"))
    return {
        "hosts": hosts.join(ids.select(F.col("id").alias("pattern_id")), "pattern_id", "left_anti"),
        "services": services.join(gone, "host_id", "left_anti"),
        "queue": queue.join(gone, "host_id", "left_anti"),
        "jobs": jobs.join(ids.select(F.col("id").alias("pattern_id")), "pattern_id", "left_anti"),
    }


def job_marks(events: DataFrame) -> DataFrame:
    """(job_id, last, began, ended) of events(seq, job_id, status, at): the latest status, start and end, each with its seq, so that they fold on."""
    ends = F.col("status").isin("completed", "failed", "timeout")
    moment = F.struct(F.col("seq").cast("long").alias("seq"), "at")
    return events.groupBy("job_id").agg(
        F.max(F.struct(F.col("seq").cast("long").alias("seq"), "status")).alias("last"), F.max(F.when(F.col("status") == "running", moment)).alias("began"), F.max(F.when(ends, moment)).alias("ended")
    )


def fold_job_marks(old: DataFrame | None, events: DataFrame) -> DataFrame:
    """The marks of jobs after further events; only the jobs of old and of the events, not their history, are read."""
    new = job_marks(events)
    return new if old is None else old.unionByName(new).groupBy("job_id").agg(*[F.max(c).alias(c) for c in ("last", "began", "ended")])


def states_of(marks: DataFrame) -> DataFrame:
    return marks.select("job_id", F.col("last.status").alias("status"), F.col("began.at").alias("started_at"), F.col("ended.at").alias("completed_at"))


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, started_at, completed_at) after events(seq, job_id, status, at).

    A later `running` sets the start anew, and nothing forbids it after an end.
    """
    return states_of(job_marks(events))


def job_id(pattern_id: Column | str, seq: Column | str, as_of: Column) -> Column:
    return S.stable_id(pattern_id, seq, F.unix_micros(as_of))


def insert_jobs(jobs: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """jobs with a pending row for each of requests(seq, pattern_id, mode); the time is part of an id, as seq may start anew in a later batch."""
    new = requests.select(
        job_id("pattern_id", "seq", as_of).alias("id"), "pattern_id", "mode", F.lit("pending").alias("status"), F.lit(None).cast("string").alias("external_id"),
        F.lit(None).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"), as_of.alias("created_at"),
    )
    return jobs.unionByName(new, allowMissingColumns=True)


def attach_external_ids(jobs: DataFrame, launched: DataFrame) -> DataFrame:
    """jobs with the external_id of launched(id, external_id) where there is one."""
    got = launched.select("id", F.col("external_id").alias("__new"))
    return jobs.join(got, "id", "left").withColumn("external_id", F.coalesce("__new", "external_id")).drop("__new")


def stamp_patterns(patterns: DataFrame, runs: DataFrame) -> DataFrame:
    """patterns with the latest times of runs(pattern_id, kind, at), kind being discovery or revalidation."""
    last = runs.groupBy(F.col("pattern_id").alias("id")).agg(
        F.max(F.when(F.col("kind") == "discovery", F.col("at"))).alias("r"), F.max(F.when(F.col("kind") == "revalidation", F.col("at"))).alias("v")
    )
    return patterns.join(last, "id", "left").withColumns({"last_discovery_at": F.greatest("last_discovery_at", "r"), "last_revalidated_at": F.greatest("last_revalidated_at", "v")}).drop("r", "v")
