"""Matching host names to domain patterns by their suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def suffix_patterns(fqdn: str) -> F.Column:
    """All patterns that a host name could match: `*.` and each run of its last labels but the whole name."""
    labels = F.split(fqdn, r"\.")
    n = F.size(labels)
    candidates = F.transform(F.sequence(F.lit(2), n), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, n), ".")))
    # the label run from i on leaves a prefix; an empty first label alone is none
    candidates = F.filter(candidates, lambda p: F.length(F.col(fqdn)) > F.length(p) - 1)
    return F.when(n >= 2, candidates).otherwise(F.array().cast("array<string>"))


def match_hosts(hosts: DataFrame, patterns: DataFrame, casefold: bool = False) -> DataFrame:
    """(fqdn, pattern_id): the first active pattern, by creation and id, that each distinct host name matches.

    An equi-join on exploded suffixes, so that neither side is compared pair by pair. Host names are made
    distinct first: feeds repeat them.
    """
    wanted = patterns.filter("active").select(F.col("id").alias("pattern_id"), F.lower("value").alias("value") if casefold else F.col("value"), F.col("created_at").alias("pattern_created_at"))
    names = hosts.select("fqdn").filter("fqdn <> ''").distinct().withColumn("key", F.lower("fqdn") if casefold else F.col("fqdn"))
    pairs = names.withColumn("value", F.explode(suffix_patterns("key"))).join(wanted, "value")
    return pairs.groupBy("fqdn").agg(F.min_by("pattern_id", F.struct("pattern_created_at", "pattern_id")).alias("pattern_id"))


def ingest_certificates(urls: DataFrame, patterns: DataFrame, hosts: DataFrame, queue: DataFrame, as_of: F.Column) -> dict[str, DataFrame]:
    """The effect of a batch of certificate URLs(seq, url).

    new_hosts: unreachable hosts of unknown type for matched names not known yet; offers: one queue row for
    each matched URL whose (url, host) is not active; unmatched: URLs that match no active pattern; rejects:
    URLs without a host.
    """
    from .workqueue import enqueue

    named = urls.withColumn("fqdn", S.url_host("url"))
    matched = named.join(match_hosts(named, patterns), "fqdn")
    fresh = matched.join(hosts.select("fqdn"), "fqdn", "left_anti").groupBy("fqdn").agg(F.min_by("pattern_id", "seq").alias("pattern_id"))
    new_hosts = fresh.select(
        S.stable_id("fqdn").alias("id"), "pattern_id", "fqdn", F.lit("unreachable").alias("status"), F.lit("unknown").alias("type"),
        F.lit(None).cast("timestamp").alias("last_seen_at"), as_of.alias("created_at"),
    )
    ids = hosts.select("fqdn", "id").unionByName(new_hosts.select("fqdn", "id"))
    offers = matched.join(ids, "fqdn").select("seq", "url", F.col("id").alias("host_id"), F.lit("certificate").alias("source"))
    return {
        "new_hosts": new_hosts,
        "offers": enqueue(offers, queue, as_of),
        "unmatched": named.filter("fqdn <> ''").join(matched.select("fqdn").distinct(), "fqdn", "left_anti").select("seq", "url", "fqdn"),
        "rejects": named.filter("fqdn = ''").select("seq", "url", F.lit("no host").alias("reason")),
    }
