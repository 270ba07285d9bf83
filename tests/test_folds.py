"""Folds against sequential simulations, and algebra that must hold."""

import random

import pytest

from tidemark.operators import fold, jobs, lifecycle, workqueue
from tidemark.sources import fixtures as X


@pytest.mark.parametrize("seed", [1, 2])
def test_queue_replay_equals_simulation(spark, seed):
    rng = random.Random(seed)
    events = [(rng.randrange(12), i, rng.choice(["enqueue", "enqueue", "start", "ok", "fail", "other"])) for i in range(1500)]
    want, busy, retries = {}, {}, {}
    for key, seq, kind in events:
        admitted = kind == "enqueue" and not busy.get(key)
        if admitted:
            retries[key] = 0
        retries[key] = retries.get(key, 0) + (kind == "fail")
        busy[key] = kind in ("enqueue", "start") or (busy.get(key) and kind not in ("ok", "fail"))
        want[seq] = (admitted, retries[key])
    got = workqueue.admit(spark.createDataFrame(events, "key long, seq long, kind string")).collect()
    assert {r["seq"]: (r["admitted"], r["retries"]) for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_lifecycle_equals_simulation(spark, seed):
    rng = random.Random(seed)
    kinds = ["alive", "unreachable", "ok", "fail", "dns_ok", "dns_fail", "certificate"]
    events = [(rng.randrange(10), i, rng.choice(kinds), rng.choice(["web", "other", "unknown"]), rng.random() < 0.5) for i in range(1500)]
    status, types, want = {}, {}, {}
    for key, seq, kind, kind_type, answered in events:
        now = before = status.get(key, "unreachable")
        if kind in ("alive", "unreachable"):
            types[key], now = kind_type, kind
        host_type = types.get(key, "unknown")
        silent = kind == "dns_ok" and host_type == "other" and not answered
        if kind == "ok" or kind == "dns_ok" and not silent:
            now = "alive"
        elif (kind in ("fail", "dns_fail") or silent) and now == "alive":
            now = "dead"
        status[key] = now
        want[seq] = (now, host_type, before == "alive" and now == "dead")
    rows = spark.createDataFrame(events, "key long, seq long, kind string, type string, answered boolean")
    assert {r["seq"]: (r["status"], r["type"], r["newly_dead"]) for r in lifecycle.lifecycle(rows).collect()} == want


def test_upsert_keeps_first_and_last_and_is_idempotent(spark, data):
    seen = X.matched_observations(spark, data)
    once = fold.upsert_hosts(None, seen)
    twice = fold.upsert_hosts(once, seen)
    columns = [c for c in once.columns if c != "seq"]
    assert once.select(columns).exceptAll(twice.select(columns)).count() == 0
    assert once.count() == once.select("fqdn").distinct().count()


def test_an_unreachable_observation_clears_the_last_sight(spark):
    schema = "seq long, pattern_id string, fqdn string, ip string, cdn string, dns string, ports string, observed_at timestamp"
    import datetime as dt

    rows = spark.createDataFrame([(1, "p", "h", "10.0.0.1", None, None, None, dt.datetime(2024, 1, 1)), (2, "q", "h", None, None, None, None, dt.datetime(2024, 1, 2))], schema)
    row = fold.upsert_hosts(None, rows).first()
    assert (row["status"], row["last_seen_at"], row["pattern_id"]) == ("unreachable", None, "p")
    bad = rows.limit(0).unionByName(spark.createDataFrame([(1, "p", "g", "not an ip", None, None, None, dt.datetime(2024, 1, 1))], schema))
    row = fold.upsert_hosts(None, bad).first()
    assert (row["status"], row["ip"]) == ("alive", None)


def test_claims_take_one_row_of_a_key_and_none_that_is_busy(spark):
    schema = "id string, host_id string, url string, source string, status string, retry_count int, created_at timestamp, updated_at timestamp"
    import datetime as dt

    at = [dt.datetime(2024, 1, 1, 0, i) for i in range(8)]
    rows = [
        ("a", "h", "u", "discovery", "failed", 1, at[0], at[0]), ("b", "h", "u", "discovery", "pending", 0, at[1], at[1]), ("c", "h", "v", "discovery", "failed", 3, at[2], at[2]),
        ("d", "h", "w", "discovery", "processing", 0, at[3], at[3]), ("e", "h", "w", "discovery", "failed", 0, at[4], at[4]), ("f", "h", "x", "discovery", "pending", 0, at[5], at[5]), ("g", "h", "y", "discovery", "pending", 0, at[6], at[6]),
    ]
    queue = spark.createDataFrame(rows, schema)
    after = {r["id"]: r["status"] for r in workqueue.claim(queue, 2, X.as_of()).collect()}
    assert [i for i in "abcefg" if after[i] == "processing"] == ["a", "f"]
    fixed = {r["id"]: r for r in workqueue.recover(queue, X.as_of()).collect()}
    assert fixed["d"]["status"] == "pending" and fixed["d"]["retry_count"] == 0


def test_deletes_cascade_and_jobs_without_start_count_nothing(spark, data):
    hosts, services = X.small_hosts(spark, data), X.services(spark, data)
    left = fold.delete_patterns(X.patterns(spark).filter("id = '1'").select("id"), hosts, services, services.select("id", "host_id", "url"), X.jobs(spark, data))
    assert left["hosts"].filter("pattern_id = '1'").count() == 0
    assert left["services"].join(left["hosts"].select("id").withColumnRenamed("id", "host_id"), "host_id", "left_anti").count() == 0
    pending = X.jobs(spark, data).filter("status = 'pending'")
    assert all(r["new_hosts"] == r["newly_dead"] == r["new_services"] == 0 for r in jobs.completion_stats(pending, hosts, services).collect())


def test_new_jobs_and_external_ids(spark, data):
    requests = spark.createDataFrame([(1, "p", "normal")], "seq long, pattern_id string, mode string")
    rows = fold.insert_jobs(X.jobs(spark, data).limit(0), requests, X.as_of())
    got = fold.attach_external_ids(rows, rows.select("id").withColumnsRenamed({}).selectExpr("id", "'x-1' as external_id")).first()
    assert (got["status"], got["external_id"], got["started_at"]) == ("pending", "x-1", None)


def test_scans_change_status_but_not_type(spark):
    hosts = spark.createDataFrame([("h", "alive", "unknown", None), ("g", "unreachable", "unknown", None)], "id string, status string, type string, last_seen_at timestamp")
    attempts = spark.createDataFrame([(1, "h", "fail"), (2, "g", "fail"), (3, "g", "ok")], "seq long, host_id string, outcome string").withColumn("at", X.as_of())
    got = {r["id"]: (r["status"], r["type"], r["last_seen_at"] is not None) for r in lifecycle.apply_scans(attempts, hosts).collect()}
    assert got == {"h": ("dead", "unknown", False), "g": ("alive", "unknown", True)}


@pytest.mark.parametrize("mode", ["exact", "parity"])
def test_completion_statistics_equal_brute_force(spark, mode):
    """One pattern holds nearly everything; times tie, cross days and are missing."""
    import datetime as dt

    rng, zero = random.Random(9), dt.datetime(2024, 3, 1)
    at = lambda: None if rng.random() < 0.05 else zero + dt.timedelta(hours=rng.randrange(0, 200))
    hosts = [(f"h{i}", "p" if i % 10 else "q", rng.choice(["dead", "alive"]), at(), at()) for i in range(60)]
    services = [(f"s{i}", f"h{rng.randrange(70)}", at()) for i in range(150)]
    told = [(f"j{i}", rng.choice(["p", "p", "q", "none"]), at()) for i in range(80)]
    want = {}
    for job, pattern, start in told:
        new = dead = found = 0
        for h, p, status, made, updated in hosts:
            if start is None or p != pattern:
                continue
            fresh = sum(1 for _, owner, served in services if owner == h and served and served >= start)
            times = 1 if mode == "exact" else max(1, fresh)
            new += times * bool(made and made >= start)
            dead += times * bool(status == "dead" and updated and updated >= start)
            found += fresh
        want[job] = (new, dead, found)
    stats = jobs.completion_stats(
        spark.createDataFrame(told, "id string, pattern_id string, started_at timestamp"),
        spark.createDataFrame(hosts, "id string, pattern_id string, status string, created_at timestamp, updated_at timestamp"),
        spark.createDataFrame(services, "id string, host_id string, created_at timestamp"), mode,
    )
    assert {r["job_id"]: (r["new_hosts"], r["newly_dead"], r["new_services"]) for r in stats.collect()} == want


def test_completion_statistics_join_no_start_with_every_host(spark):
    """With one pattern and thousands of starts and hosts, no step makes more rows than there are inputs."""
    n = 3000
    at = lambda c: f"timestamp '2024-03-01' + make_dt_interval(0, 0, {c})"
    ids = spark.range(n)
    stats = jobs.completion_stats(
        ids.selectExpr("cast(id as string) id", "'p' pattern_id", f"{at('id')} started_at"),
        ids.selectExpr("cast(id as string) id", "'p' pattern_id", "'dead' status", f"{at('id')} created_at", f"{at('id')} updated_at"),
        ids.selectExpr("cast(id as string) id", "cast(id as string) host_id", f"{at('id')} created_at"),
    )
    stats.collect()
    plan = stats._jdf.queryExecution().executedPlan()
    made, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined():
            made.append(rows.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 6 * n


def test_known_urls_are_the_newest(spark):
    rows = spark.sql("select cast(id as string) id, 'h' || (id % 2) host_id, 'u' || id url, timestamp '2024-01-01' + make_dt_interval(0, id % 7) scanned_at from range(20)")
    hosts = spark.sql("select 'h0' id union all select 'h1'")
    got = [(r["host_id"], r["url"]) for r in lifecycle.known_urls(rows, hosts, 3).collect()]
    newest = lambda host: sorted((n for n in range(20) if n % 2 == host), key=lambda n: (-(n % 7), str(n)))[:3]
    assert sorted(got) == sorted((f"h{h}", f"u{n}") for h in (0, 1) for n in newest(h))
    assert lifecycle.known_urls(rows, hosts).count() == 20
