"""JSON feeds with broken lines, read as a batch and as a stream; roll-ups kept up from changes."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fold, rollup
from tidemark.plans import registry
from tidemark.sources import feeds, schemas
from tidemark.sources import fixtures as X
from tidemark.streaming import streams

LINES = [
    '{"job_id":"1","host":{"fqdn":"a.example.com","ip":"10.0.0.1"}}',
    '{"job_id":"1","host":{"fqdn":"b.example.com"',
    "",
    "   ",
    "nothing",
    '{"job_id":"1","host":"text"}',
    '{"job_id":"9","host":{"fqdn":"c.example.com"}}',
    '{"job_id":"1","host":{"fqdn":""}}',
    '{"job_id":"1","extra":[1,2],"host":{"fqdn":"d.example.com","ports":"{}"}}',
    "null",
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(f"file://{tmp_path}/in")
    return f"file://{tmp_path}"


def test_broken_lines_are_refused_with_their_text(spark, folder):
    jobs = spark.createDataFrame([("1", "p")], "id string, pattern_id string")
    good, bad = feeds.accept_discoveries(feeds.read_discoveries(spark, f"{folder}/in"), jobs)
    assert sorted((r["fqdn"], r["pattern_id"], r["ports"]) for r in good.collect()) == [("a.example.com", "p", None), ("d.example.com", "p", "{}")]
    assert "raw" not in good.columns
    assert sorted((r["reason"], r["raw"]) for r in bad.collect()) == sorted(
        [("broken record", LINES[i]) for i in (1, 4, 5, 9)] + [("unknown job", LINES[6]), ("no fqdn", LINES[7])]
    )


def test_stream_and_batch_read_alike(spark, folder):
    source = feeds.read_discoveries(spark, f"{folder}/in", streaming=True)
    assert source.isStreaming
    source.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(feeds.read_discoveries(spark, f"{folder}/in"))


def test_other_feeds(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    lines = ['{"url":"https://a.example.com/x"}', '{"url":7', '{"url":"nothing"}', '{"seq":1,"job_id":"j","status":"running","at":"2024-01-01T00:00:00Z"}', '{"seq":"one","job_id":"j"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = feeds.accept_certificates(feeds.read_feed(spark, path, schemas.CERTIFICATE_FEED))
    assert [r["fqdn"] for r in good.collect()] == ["a.example.com"] and sorted(r["reason"] for r in bad.collect()) == ["broken record", "no host", "no host", "no host"]
    good, bad = feeds.accept_job_events(feeds.read_feed(spark, path, schemas.JOB_STATUS_FEED), spark.createDataFrame([("j",)], "id string"))
    assert good.count() == 1 and sorted((r["reason"], r["raw"]) for r in bad.collect()) == sorted([("broken record", lines[1]), ("broken record", lines[4]), ("bad status", lines[0]), ("bad status", lines[2])])


def test_rollup_follows_every_batch(spark, data, tmp_path):
    """After each batch of either feed, repeated ones too, the stored counts are those of a count of all hosts."""
    hosts, counts, queue = (make(spark, f"file://{tmp_path}/{n}") for n, make in enumerate([streams.host_table, streams.count_table, streams.queue_table]))
    seen = X.matched_observations(spark, data)
    found, told = streams.fold_discoveries(hosts, counts), streams.ingest_certificates(hosts, queue, X.patterns(spark), X.as_of(), counts)
    pages = X.load(spark, data, "pages").select(F.col("page_id").alias("seq"), "url")
    steps = [(found, seen.filter("seq % 3 = 0"), 0), (told, pages.filter("seq % 2 = 0"), 0), (found, seen.filter("seq % 3 = 1"), 1), (found, seen.filter("seq % 3 = 1"), 1), (found, seen.withColumn("ip", F.when(F.col("seq") % 2 == 0, F.col("ip"))), 2)]
    for run, rows, number in steps:
        run(rows, number)
        every = rollup.pattern_rollup(X.patterns(spark), hosts.read())
        assert sorted(map(str, rollup.of_patterns(X.patterns(spark), counts.read()).collect())) == sorted(map(str, every.collect()))


def test_a_lost_count_is_made_up_for(spark, data, tmp_path):
    hosts, counts = streams.host_table(spark, f"file://{tmp_path}/h"), streams.count_table(spark, f"file://{tmp_path}/c")
    run, seen = streams.fold_discoveries(hosts, counts), X.matched_observations(spark, data)
    run(seen.filter("seq % 2 = 0"), 0)
    change, counts.change = counts.change, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        run(seen, 1)
    counts.change = change
    run(seen, 1)
    every = rollup.pattern_rollup(X.patterns(spark), hosts.read())
    assert sorted(map(str, rollup.of_patterns(X.patterns(spark), counts.read()).collect())) == sorted(map(str, every.collect()))


def test_changes_name_only_what_changes(spark):
    row = "pattern_id string, status string, type string"
    old = spark.createDataFrame([("1", "alive", "web"), ("2", "alive", "web"), (None, "alive", "web")], row)
    new = spark.createDataFrame([("1", "dead", "web"), ("2", "alive", "web"), ("3", "alive", "other"), (None, "dead", "web")], row)
    assert sorted(tuple(r) for r in rollup.signed_counts(old, new).collect()) == [("1", 0, -1, 1, 0, 0), ("3", 1, 1, 0, 0, 0)]
    assert fold.HOST_FIRST[0] == "id" and "stream_rollup" in registry.queries()
