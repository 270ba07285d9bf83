"""Roll-ups over patterns, revalidation digests and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


COUNTS = ("total", "alive", "dead", "unreachable", "web")


def pattern_rollup(patterns: DataFrame, hosts: DataFrame) -> DataFrame:
    """(id, value, active, total, alive, dead, unreachable, web) of every pattern; hosts are counted before the join."""
    counts = hosts.groupBy(F.col("pattern_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "alive").alias("alive"),
        F.count_if(F.col("status") == "dead").alias("dead"),
        F.count_if(F.col("status") == "unreachable").alias("unreachable"),
        F.count_if(F.col("type") == "web").alias("web"),
    )
    return of_patterns(patterns, counts)


def of_patterns(patterns: DataFrame, counts: DataFrame) -> DataFrame:
    """Every pattern with its counts(id, ...), none being 0."""
    joined = patterns.select("id", "value", "active").join(counts, "id", "left")
    return joined.select("id", "value", "active", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def signed_counts(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(id, counts): by how much the counts of patterns change when rows of hosts become others; hosts without a pattern don't count.

    old and new are the changed hosts alone, before and after; patterns whose counts stay are left out.
    """
    rows = new.select("pattern_id", "status", "type", F.lit(1).alias("sign"))
    if old is not None:
        rows = rows.unionByName(old.select("pattern_id", "status", "type", F.lit(-1).alias("sign")))
    tests = {"total": F.lit(True), "alive": F.col("status") == "alive", "dead": F.col("status") == "dead", "unreachable": F.col("status") == "unreachable", "web": F.col("type") == "web"}
    sums = [F.coalesce(F.sum(F.when(test, F.col("sign"))), F.lit(0)).alias(name) for name, test in tests.items()]
    changed = rows.filter("pattern_id is not null").groupBy(F.col("pattern_id").alias("id")).agg(*sums)
    return changed.filter(" or ".join(f"{c} <> 0" for c in COUNTS))


def added(held: DataFrame | None, changes: DataFrame) -> DataFrame:
    """(id, counts) of the patterns of changes, added to what held has of them."""
    rows = changes.select("id", *COUNTS)
    rows = rows if held is None else rows.unionByName(held.select("id", *COUNTS))
    return rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def totals(rollup: DataFrame) -> DataFrame:
    """One row: the number of patterns and the sums of their counts."""
    return rollup.agg(F.count(F.lit(1)).alias("patterns"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "alive", "dead", "unreachable", "web")])


def host_cube(hosts: DataFrame) -> DataFrame:
    """Host counts for every combination of pattern, status and type, each also taken together (null)."""
    return hosts.cube("pattern_id", "status", "type").agg(F.count(F.lit(1)).alias("n"))


def revalidation_digest(checked: DataFrame, offers: DataFrame, patterns: DataFrame, seconds: int) -> DataFrame:
    """One row: active patterns, no new hosts, hosts that died, URLs offered for a new scan, duration."""
    dead = checked.agg(F.count_if("newly_dead").alias("newly_dead"))
    urls = offers.agg(F.count(F.lit(1)).alias("urls_offered"))
    n = patterns.filter("active").agg(F.count(F.lit(1)).alias("patterns"))
    one = F.lit(1)
    joined = n.withColumn("k", one).join(dead.withColumn("k", one), "k").join(urls.withColumn("k", one), "k")
    return joined.select("patterns", F.lit(0).cast("long").alias("new_hosts"), "newly_dead", "urls_offered", F.lit(seconds).cast("long").alias("duration_seconds"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "fqdn") -> DataFrame:
    """(key, change): keys only in new (added) and only in old (vanished)."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("vanished")))
