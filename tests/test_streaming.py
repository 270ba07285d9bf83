"""Streams give what the batch operators give, and batches that come again change nothing."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold, match, workqueue
from tidemark.sources import fixtures as X
from tidemark.streaming import streams


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def parts(rows, path, key, n=3):
    for i in range(n):
        rows.filter(F.col(key) % n == i).coalesce(1).write.mode("append").parquet(path)


def test_discoveries(spark, data, folder):
    seen = X.matched_observations(spark, data).withColumn("batch", F.floor(F.col("seq") / 20)).cache()
    for i in range(3):
        seen.filter(F.col("batch") % 3 == i).drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    hosts = streams.host_table(spark, f"{folder}/hosts")
    source = spark.readStream.schema(seen.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.start(source, streams.fold_discoveries(hosts), f"{folder}/cp").awaitTermination()
    assert hosts.latest() == 2
    order = spark.read.parquet(f"{folder}/in")
    got = {r["fqdn"] for r in hosts.read().collect()}
    assert got == {r["fqdn"] for r in order.select("fqdn").distinct().collect()}
    before = sorted(map(str, hosts.read().collect()))
    streams.fold_discoveries(hosts)(order, 2)  # the last batch again
    assert sorted(map(str, hosts.read().collect())) == before


def test_certificates(spark, data, folder):
    pages = X.load(spark, data, "pages").select(F.col("page_id").alias("seq"), "url")
    parts(pages, f"{folder}/in", "seq")
    hosts, queue = streams.host_table(spark, f"{folder}/hosts"), streams.queue_table(spark, f"{folder}/queue")
    source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.start(source, streams.ingest_certificates(hosts, queue, X.patterns(spark), X.as_of()), f"{folder}/cp").awaitTermination()
    matched = match.match_hosts(pages.withColumn("fqdn", X.S.url_host("url")), X.patterns(spark))
    assert hosts.read().select("fqdn").distinct().count() == hosts.read().count() == matched.count()
    assert queue.read().count() == pages.withColumn("fqdn", X.S.url_host("url")).join(matched, "fqdn").select("url").distinct().count()


def test_job_states(spark, data, folder):
    events = X.job_events(spark, data).filter("status <> 'pending'")
    parts(events, f"{folder}/in", "seq")
    kept = streams.job_table(spark, f"{folder}/jobs")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.start(source, streams.fold_job_states(kept), f"{folder}/cp").awaitTermination()
    assert sorted(map(str, fold.states_of(kept.read()).collect())) == sorted(map(str, fold.job_states(events).collect()))


def test_queue_state(spark, data, folder):
    """Batches by ranges of seq, each carrying on from the keys that were busy."""
    events = X.queue_events(spark, data).select("key", "seq", "kind")
    busy = streams.busy_table(spark, f"{folder}/busy")
    run = streams.admit_events(busy, f"{folder}/out")
    top = events.agg(F.max("seq")).first()[0] + 1
    for n in range(3):
        run(events.filter((F.col("seq") * 3 >= n * top) & (F.col("seq") * 3 < (n + 1) * top)), n)
    run(events, 2)  # the last batch again
    got = {(r["key"], r["seq"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {(r["key"], r["seq"]) for r in workqueue.admit(events).filter("admitted").select("key", "seq").collect()}


def test_versions_hold_what_changed_and_compact(spark, folder):
    table = streams.Versions(spark, f"{folder}/t", "k long, v long", "k", buckets=4, compact_every=3)
    want = {}
    for n in range(11):
        rows = {k: 100 * n + k for k in range(n, 30, n + 1)}
        table.change(spark.createDataFrame(list(rows.items()), "k long, v long"), "s", n)
        want |= rows
        assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert table.latest() == table.applied("s") == 10 and len(table._parts("base")) <= 2 and len(table._parts("delta")) <= 6
    some = spark.createDataFrame([(3,), (29,), (500,)], "k long")
    assert {r["k"]: r["v"] for r in table.read(keys=some).collect()} == {k: want[k] for k in (3, 29)}
    files = table._fs.listStatus(table._path(f"{folder}/t/{table._parts('delta')[10][0]}"))
    assert sum(f.isDirectory() for f in files) <= 3  # the last change wrote its own rows only


def test_repeats_and_days(spark, data, folder):
    events = X.queue_events(spark, data)
    parts(events, f"{folder}/in", "seq")
    urls = spark.readStream.schema(events.schema).parquet(f"{folder}/in").select(F.concat(F.lit("u"), "key").alias("url"), "at")
    streams.distinct_urls(urls, delay="4000 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == events.select("key").distinct().count()
    assert streams.daily_activity(events).agg(F.sum("n")).first()[0] == events.count()


def test_scans_settle_alert_and_claim(spark, folder):
    at = "timestamp '2024-01-01'"
    hosts, queue = streams.host_table(spark, f"{folder}/hosts"), streams.queue_table(spark, f"{folder}/queue")
    hosts.write(spark.sql(f"select * from values ('h1', '1', 'a.example.com', 'unreachable', 'unknown', {at}), ('h2', '1', 'b.example.com', 'alive', 'web', {at}) t(id, pattern_id, fqdn, status, type, last_seen_at)"), 0)
    rows = f"('q1', 'h1', 'https://a.example.com', 'certificate', 'processing', 0, {at}, {at}), ('q2', 'h2', 'https://b.example.com', 'discovery', 'processing', 0, {at}, {at}), ('q3', 'h2', 'https://b.example.com/x', 'discovery', 'pending', 0, {at}, {at})"
    queue.write(spark.sql(f"select * from values {rows} t(id, host_id, url, source, status, retry_count, created_at, updated_at)"), 0)
    body = '{"chain":[{"title":"Hi","status_code":200}],"technologies":[]}'
    spark.createDataFrame([(1, "q1", 200, body), (2, "q2", 500, None)], "seq long, queue_id string, http_status int, body string").withColumn("at", X.as_of()).coalesce(1).write.parquet(f"{folder}/in")
    source = spark.readStream.schema("seq long, queue_id string, http_status int, body string, at timestamp").parquet(f"{folder}/in")
    run = streams.process_scans(queue, hosts, f"{folder}/alerts", X.patterns(spark), 5, X.as_of())
    streams.start(source, run, f"{folder}/cp").awaitTermination()
    assert {r["id"]: r["status"] for r in hosts.read().collect()} == {"h1": "alive", "h2": "dead"}
    assert {r["id"]: (r["status"], r["retry_count"]) for r in queue.read().collect()} == {"q1": ("done", 0), "q2": ("processing", 1), "q3": ("processing", 0)}
    (alert,) = spark.read.json(f"{folder}/alerts").collect()
    assert '"title":"Hi"' in alert["payload"] and '"wildcard":"*.example.com"' in alert["payload"]
    run(spark.read.parquet(f"{folder}/in"), 0)  # the batch again
    assert queue.latest() == 1


def test_completed_jobs_are_digested(spark, data, folder):
    from tidemark.plans import registry

    jobs = X.jobs(spark, data)
    stats = registry.job_completion_stats_exact(spark, data)
    kept = streams.job_table(spark, f"{folder}/jobs")
    ids = jobs.filter("status = 'completed'").select("id").limit(2).collect()
    batch = spark.createDataFrame([(1, ids[0]["id"], "running"), (2, ids[0]["id"], "completed"), (3, ids[1]["id"], "running")], "seq long, job_id string, status string").withColumn("at", X.as_of())
    streams.digest_job_states(kept, f"{folder}/digests", jobs, stats, X.as_of())(batch, 0)
    (digest,) = spark.read.json(f"{folder}/digests").collect()
    assert digest["job_id"] == ids[0]["id"] and '"event":"discovery_digest"' in digest["payload"]


def test_buckets_follow_the_table(spark, folder):
    table = streams.Versions(spark, f"{folder}/t", "k long, v long", "k", buckets=2, compact_every=2, rows_per_bucket=100)
    for n in range(7):
        table.change(spark.range(n * 200, n * 200 + 250).selectExpr("id as k", f"{n} as v"), "s", n)
    assert max(b for _, b in table._parts("base").values()) > 4
    some = spark.range(150, 260).withColumnRenamed("id", "k")
    assert {r["k"]: r["v"] for r in table.read(keys=some).collect()} == {k: int(k >= 200) for k in range(150, 260)}
    assert table.read().count() == 1450


def upserted(spark, data, parts, order):
    """The table of hosts after the parts of two feeds in the given order, by one batch fold after the other."""
    hosts = spark.createDataFrame([], streams.schemas.HOSTS)
    empty = spark.createDataFrame([], streams.schemas.QUEUE)
    for feed, n in order:
        rows = parts[feed][n]
        if feed == "discoveries":
            new = fold.upsert_hosts(hosts.select("fqdn", *fold.HOST_FIRST, *fold.HOST_LAST), rows).drop("seq")
        else:
            new = hosts.unionByName(match.ingest_certificates(rows, X.patterns(spark), hosts, empty, X.as_of())["new_hosts"], allowMissingColumns=True)
        hosts = spark.createDataFrame(new.collect(), new.schema)
    return hosts


def test_two_feeds_write_one_table_of_hosts(spark, data, folder):
    """Batches of both streams, interleaved and repeated, give what the folds give in that order."""
    seen = X.matched_observations(spark, data)
    pages = X.load(spark, data, "pages").select(F.col("page_id").alias("seq"), "url")
    parts = {"discoveries": [seen.filter(F.col("seq") % 5 == n) for n in (0, 1, 2)], "certificates": [pages.filter(F.col("seq") % 5 == n) for n in (4, 3, 0)]}
    order = [("certificates", 0), ("discoveries", 0), ("discoveries", 1), ("certificates", 1), ("certificates", 2), ("discoveries", 2)]
    hosts, queue = streams.host_table(spark, f"{folder}/hosts"), streams.queue_table(spark, f"{folder}/queue")
    run = {"discoveries": streams.fold_discoveries(hosts), "certificates": streams.ingest_certificates(hosts, queue, X.patterns(spark), X.as_of())}
    for feed, n in order:
        run[feed](parts[feed][n], n)
        run[feed](parts[feed][n], n)
    assert hosts.latest() == 5 and (hosts.applied("discoveries"), hosts.applied("certificates")) == (2, 2)
    want, got = upserted(spark, data, parts, order), hosts.read()
    columns = ["fqdn", "id", "pattern_id", "ip", "status", "type", "last_seen_at", "created_at"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert queue.read().count() == pages.filter("seq % 5 in (0, 3, 4)").select("url").distinct().join(pages.withColumn("fqdn", X.S.url_host("url")), "url").join(want.select("fqdn"), "fqdn").select("url").distinct().count()


def test_a_batch_cut_short_between_its_tables_is_finished(spark, data, folder):
    pages = X.load(spark, data, "pages").select(F.col("page_id").alias("seq"), "url")
    hosts, queue = streams.host_table(spark, f"{folder}/hosts"), streams.queue_table(spark, f"{folder}/queue")
    run = streams.ingest_certificates(hosts, queue, X.patterns(spark), X.as_of())
    failing, queue.change = queue.change, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        run(pages, 0)
    assert hosts.applied("certificates") == 0 and queue.latest() == -1
    queue.change = failing
    run(pages, 0)
    named = pages.withColumn("fqdn", X.S.url_host("url"))
    assert hosts.latest() == 0 and queue.read().count() == named.join(match.match_hosts(named, X.patterns(spark)), "fqdn").select("url").distinct().count()


def test_the_mark_of_another_application_is_not_overwritten(spark, folder):
    one = streams.Versions(spark, f"{folder}/t", "k long, v long", "k")
    other = streams.Versions(spark, f"{folder}/t", "k long, v long", "k")
    rows = spark.createDataFrame([(1, 1)], "k long, v long")
    one.change(rows, "a", 0)
    other.latest = lambda: -1  # it looked before the first one was done
    with pytest.raises(Exception, match="exist"):
        other.change(rows.withColumn("v", F.lit(2)), "b", 0)
    assert one.read().collect() == [(1, 1)] and one.applied("b") == -1
