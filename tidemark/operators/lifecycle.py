"""Host lifecycles: ordered events folded by windows, revalidation, alerts of new services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .automaton import SIZE, Machine, block_of, final, starts

URLS_PER_HOST = 1000


def lifecycle(events: DataFrame) -> DataFrame:
    """events(key, seq, kind, type, answered) with the host's type, status and what changed, row by row.

    Kinds: alive and unreachable (observations, which carry the type), ok and fail (page scans), dns_ok and
    dns_fail (revalidation; answered says whether a known port did), seed rows alive, dead or unreachable with
    kind `seed_<status>`, and others that change nothing. Observations, ok and a positive revalidation set the
    status; fail, dns_fail and silent ports only turn an alive host dead.
    """
    order = Window.partitionBy("key").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    observed = kind.isin("alive", "unreachable") | kind.startswith("seed_")
    rows = events.withColumn("type", F.coalesce(F.last(F.when(observed, F.col("type")), ignorenulls=True).over(upto), F.lit("unknown")))
    silent = (kind == "dns_ok") & (F.col("type") == "other") & ~F.coalesce(F.col("answered"), F.lit(False))
    sets = (
        F.when(kind.isin("alive", "unreachable"), kind)
        .when(kind.startswith("seed_"), F.substring(kind, 6, 20))
        .when(kind == "ok", "alive")
        .when((kind == "dns_ok") & ~silent, "alive")
    )
    rows = rows.withColumns({"sets": sets, "kills": (kind.isin("fail", "dns_fail") | silent).cast("int")})
    rows = rows.withColumn("segment", F.sum(F.col("sets").isNotNull().cast("int")).over(upto))
    within = Window.partitionBy("key", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    base, killed = F.max("sets").over(within), F.max("kills").over(within)
    rows = rows.withColumn("status", F.when(base.isNull(), "unreachable").when((base == "alive") & (killed == 1), "dead").otherwise(base))
    rows = rows.withColumn("before", F.coalesce(F.lag("status").over(order), F.lit("unreachable")))
    rows = rows.withColumn("newly_dead", (F.col("status") == "dead") & (F.col("before") == "alive"))
    return rows.drop("sets", "kills", "segment")


def current(lived: DataFrame) -> DataFrame:
    """(key, status, type, newly_dead): each host's state after its last event and how often it died."""
    return lived.groupBy("key").agg(F.max_by("status", "seq").alias("status"), F.max_by("type", "seq").alias("type"), F.count_if("newly_dead").alias("newly_dead"))


STATUSES, TYPED = ("unreachable", "alive", "dead"), ("", "other", "web")


def _life() -> Machine:
    """States are status and whether the type is `other`. Codes: observed as a status with no, the other or another type; found; answered by DNS alone; failed."""

    def effect(status: Callable[[int, bool], int], kind: str = "") -> list[tuple[int, int, int, bool]]:
        out = []
        for was in range(3):
            for other in (False, True):
                now = status(was, other)
                out.append((2 * now + int(other if kind == "" else kind == "other"), int(was == 1 and now == 2), 0, False))
        return out

    observed = [effect(lambda was, other, now=now: now, kind) for now in range(3) for kind in TYPED]
    killed = lambda was: 2 if was == 1 else was
    return Machine([*observed, effect(lambda was, other: 1), effect(lambda was, other: killed(was) if other else 1), effect(lambda was, other: killed(was)), effect(lambda was, other: was)])


LIFE = _life()


def _codes(events: DataFrame) -> DataFrame:
    """events(key, seq, code) of lifecycle events."""
    kind, place = F.col("kind"), F.lit(None).cast("int")
    for n, status in enumerate(STATUSES):
        place = F.when(kind.isin(f"seed_{status}", *([status] if status != "dead" else [])), 3 * n).otherwise(place)
    typed = F.when(F.col("type").isNull(), 0).when(F.col("type") == "other", 1).otherwise(2)
    silent = ~F.coalesce(F.col("answered"), F.lit(False))
    code = F.when(place.isNotNull(), place + typed).when((kind == "ok") | ((kind == "dns_ok") & ~silent), 9).when(kind == "dns_ok", 10).when(kind.isin("fail", "dns_fail"), 11).otherwise(12)
    return events.select("key", F.col("seq").cast("long").alias("seq"), code.cast("int").alias("code"))


def _observed() -> F.Column:
    return F.when(F.col("kind").isin("alive", "unreachable") | F.col("kind").startswith("seed_"), F.col("type"))


def final_states(events: DataFrame, size: int = SIZE) -> DataFrame:
    """What `current` says of `lifecycle`, by composing what the events of each block do: a hot host spreads over tasks."""
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.floor(F.col("state") / 2).cast("int") + 1)
    ended = final(_codes(events), LIFE, 0, size).select(F.col("key").alias("of"), status.alias("status"), F.col("count").alias("newly_dead"))
    types = events.groupBy("key").agg(F.max_by(_observed(), F.when(_observed().isNotNull(), F.col("seq"))).alias("type"))
    return types.join(ended, F.col("key").eqNullSafe(F.col("of"))).select("key", "status", F.coalesce("type", F.lit("unknown")).alias("type"), "newly_dead")


def lifecycle_in_blocks(events: DataFrame, size: int = SIZE) -> DataFrame:
    """`lifecycle`, row by row, with windows over blocks of `size` sequence numbers instead of whole hosts.

    Each block starts from a seed row of the state that the blocks before it leave.
    """
    block = block_of(F.col("seq").cast("long"), size)
    began = starts(_codes(events), LIFE, 0, size)
    last = events.groupBy("key", block.alias("block")).agg(F.max_by(_observed(), F.when(_observed().isNotNull(), F.col("seq"))).alias("type"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    typed = last.select(F.col("key").alias("of"), F.col("block").alias("at"), F.last("type", ignorenulls=True).over(before).alias("type"))
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.floor(F.col("state") / 2).cast("int") + 1)
    seeds = began.join(typed, F.col("key").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).select(
        F.struct("key", "block").alias("key"), F.lit(-(1 << 62)).alias("seq"), F.concat(F.lit("seed_"), status).alias("kind"), "type", F.lit(None).cast("boolean").alias("answered")
    )
    rows = lifecycle(events.withColumn("key", F.struct("key", block.alias("block"))).unionByName(seeds, allowMissingColumns=True))
    return rows.filter(F.col("seq") > -(1 << 62)).withColumn("key", F.col("key.key"))


def new_service_alerts(lived: DataFrame) -> DataFrame:
    """Scans that went well, of URLs found by certificates, at hosts that were unreachable until then."""
    return lived.filter("kind = 'ok' and source = 'certificate' and before = 'unreachable'")


def revalidate(hosts: DataFrame, probes: DataFrame) -> DataFrame:
    """hosts with old_status, the status after probes(fqdn, dns_ok, answered), newly_dead and offers_urls.

    answered lists the ports that replied. Hosts without a probe stay as they are; dead hosts may revive.
    """
    seen = hosts.join(probes.select("fqdn", "dns_ok", "answered"), "fqdn", "left")
    replied = F.arrays_overlap(S.open_ports("ports"), F.coalesce("answered", F.array().cast("array<string>")))
    silent = ~F.col("dns_ok") | ((F.col("type") == "other") & ~replied)
    old = F.col("old_status")
    status = F.when(F.col("dns_ok").isNull(), old).when(silent, F.when(old == "alive", "dead").otherwise(old)).otherwise("alive")
    return (
        seen.withColumnRenamed("status", "old_status")
        .withColumn("status", status)
        .withColumn("newly_dead", (F.col("old_status") == "alive") & (F.col("status") == "dead"))
        .withColumn("offers_urls", F.coalesce(F.col("dns_ok"), F.lit(False)) & (F.col("type") == "web"))
    )


def known_urls(services: DataFrame, hosts: DataFrame, limit: int = URLS_PER_HOST) -> DataFrame:
    """(host_id, url): the newest `limit` scanned URLs of each host."""
    rank = F.row_number().over(Window.partitionBy("host_id").orderBy(F.desc_nulls_last("scanned_at"), "id"))
    return services.join(hosts.select(F.col("id").alias("host_id")), "host_id", "left_semi").withColumn("n", rank).filter(F.col("n") <= limit).select("host_id", "url", "n")


def apply_scans(attempts: DataFrame, hosts: DataFrame) -> DataFrame:
    """hosts after scan attempts(seq, host_id, outcome, at): ok means alive and seen, fail turns alive hosts dead; the type stays."""
    events = attempts.select(F.col("host_id").alias("key"), "seq", F.col("outcome").alias("kind"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("boolean").alias("answered"))
    seed = hosts.join(attempts.select(F.col("host_id").alias("id")).distinct(), "id", "left_semi").select(
        F.col("id").alias("key"), F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("seed_"), "status").alias("kind"), "type", F.lit(None).cast("boolean").alias("answered")
    )
    state = current(lifecycle(seed.unionByName(events))).select(F.col("key").alias("id"), F.col("status").alias("__status"))
    seen = attempts.filter("outcome = 'ok'").groupBy(F.col("host_id").alias("id")).agg(F.max("at").alias("__seen"))
    out = hosts.join(state, "id", "left").join(seen, "id", "left")
    return out.withColumn("status", F.coalesce("__status", "status")).withColumn("last_seen_at", F.greatest("__seen", "last_seen_at")).drop("__status", "__seen")
