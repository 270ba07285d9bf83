"""The inventory's folds over Structured Streaming sources.

Each stream hands its micro-batches to the batch operators. State is a folder of Parquet in versions: a batch reads
the rows of the keys that it names, folds them, writes what changed as the next version and only then marks it by the
stream's name and the batch's number, so a batch that runs again after a failure finds its mark and changes nothing. Streams
that write one table, as both feeds of hosts do, each have marks of their own.
"""

from __future__ import annotations

import json
import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import scalars as S
from ..operators import fold, lifecycle, match, payloads, rollup, workqueue
from ..operators import jobs as job_ops
from ..sources import feeds, schemas

Batch = Callable[[DataFrame, int], None]


#: A table's parts are dealt out to so many buckets at least, and to about one for so many rows of its last base.
LEAST_BUCKETS, ROWS_PER_BUCKET = 8, 500_000
_turns: dict[str, threading.RLock] = defaultdict(threading.RLock)


class Versions:
    """Versions of one table of the given schema, whose rows have a key, below a folder; several streams may write it.

    `delta=<n>-<stream>-<buckets>/` holds the rows that version n changed, dealt out to buckets by the column `bucket_by`;
    `base=<n>-<stream>-<buckets>/` the whole table. A version counts once `done/<n>` exists, which tells whose it is and the last
    batch of every stream so far. Every `compact_every` versions a base is written; the last two bases and what came after
    them stay. Reading takes the newest row of each key, of the wanted buckets alone.

    Streams of one application take turns. A mark is made only where there is none: if another application came first, the
    later batch fails, and runs again from what the other one left.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, bucket_by: str | None = None, buckets: int = LEAST_BUCKETS, compact_every: int = 8, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.folder, self.key, self.bucket_by = spark, folder.rstrip("/"), key, bucket_by or key
        self.schema, self.buckets, self.compact_every, self.rows_per_bucket = StructType.fromDDL(schema), buckets, compact_every, rows_per_bucket
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def turn(self) -> threading.RLock:
        """To be held from reading a table to changing it."""
        return _turns[self.folder]

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _marked(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.folder}/done"))

    def _mark(self, version: int) -> dict:
        file = self._fs.open(self._path(f"{self.folder}/done/{version}"))
        try:
            return json.loads(file.readUTF())
        finally:
            file.close()

    def latest(self) -> int:
        return max(self._marked(), default=-1)

    def _batches(self) -> dict[str, list[int]]:
        n = self.latest()
        return {} if n < 0 else self._mark(n)["batches"]

    def applied(self, stream: str) -> int:
        """The last batch of the stream that the table holds, or -1."""
        return self._batches().get(stream, [-1, -1])[0]

    def before(self, stream: str, batch: int) -> int:
        """The version that the stream's batch changed, or the latest if it has not changed any yet."""
        number, version = self._batches().get(stream, [-1, -1])
        return version - 1 if number == batch else self.latest()

    def _parts(self, kind: str) -> dict[int, tuple[str, int]]:
        """The folder and the buckets of the whole bases, or of the deltas that their marks name."""
        found = {}
        for name in self._names(self.folder):
            if name.startswith(f"{kind}="):
                version, stream, buckets = name.split("=")[1].rsplit("-", 2)
                if kind == "base" and self._fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS")):
                    found[int(version)] = name, int(buckets)
                elif kind == "delta" and self._fs.exists(self._path(f"{self.folder}/done/{version}")) and self._mark(int(version))["stream"] == stream:
                    found[int(version)] = name, int(buckets)
        return found

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The table as of a version; with keys, a table with the column `bucket_by`, only the rows that have one of its values."""
        n = self.latest() if version is None else version
        return None if n < 0 else self._rows(n, keys)

    def _rows(self, n: int, keys: DataFrame | None = None, extra: tuple[str, int] | None = None) -> DataFrame:
        bases, deltas = self._parts("base"), self._parts("delta")
        base = max([b for b in bases if b <= n], default=-1)
        parts = ([(base, *bases[base])] if base >= 0 else []) + [(m, *deltas[m]) for m in sorted(deltas) if base < m <= n] + ([(n, *extra)] if extra else [])
        schema = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        rows, wanted = self.spark.createDataFrame([], schema).withColumn("version", F.lit(-1)), {}
        for m, name, buckets in parts:
            part = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
            if keys is not None:
                if buckets not in wanted:
                    wanted[buckets] = [r["b"] for r in keys.select(_bucket(self.bucket_by, buckets).alias("b")).distinct().collect()]
                part = part.filter(F.col("bucket").isin(wanted[buckets]))
            rows = rows.unionByName(part.withColumn("version", F.lit(m)))
        if keys is not None:
            rows = rows.join(keys.select(self.bucket_by).distinct(), self.bucket_by, "left_semi")
        if len(parts) > 1:
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in self.schema.names if c != self.key]), "version").alias("row")).select(self.key, "row.*")
        return rows.select(*self.schema.names)

    def _put(self, rows: DataFrame, name: str, buckets: int) -> None:
        held = [F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        bucketed = rows.select(*held).withColumn("bucket", _bucket(self.bucket_by, buckets))
        bucketed.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _commit(self, version: int, stream: str, batches: dict[str, list[int]]) -> None:
        file = self._fs.create(self._path(f"{self.folder}/done/{version}"), False)
        file.writeUTF(json.dumps({"stream": stream, "batches": batches}))
        file.close()

    def write(self, rows: DataFrame, version: int = 0) -> None:
        """The table's first version: these rows alone."""
        self._put(rows, f"base={version}-start-{self.buckets}", self.buckets)
        self._commit(version, "start", {})

    def change(self, rows: DataFrame, stream: str, batch: int) -> None:
        """The next version, by which a stream's batch replaces or adds the rows of these keys; missing columns are null."""
        with self.turn():
            version, bases = self.latest() + 1, self._parts("base")
            last = max(bases, default=-1)
            buckets = bases[last][1] if bases else self.buckets
            delta = f"delta={version}-{stream}-{buckets}"
            self._put(rows, delta, buckets)
            if version - last >= self.compact_every:
                held = self.spark.read.parquet(f"{self.folder}/{bases[last][0]}").count() if bases else 0
                wider = max(self.buckets, 1 << max(0, held // self.rows_per_bucket).bit_length())
                self._put(self._rows(version, extra=(delta, buckets)), f"base={version}-{stream}-{wider}", wider)
            self._commit(version, stream, self._batches() | {stream: [batch, version]})
            self._clear()

    def _clear(self) -> None:
        bases = sorted(self._parts("base"))
        if len(bases) <= 2:
            return
        for name in self._names(self.folder):
            kind, _, rest = name.partition("=")
            if kind in ("base", "delta") and (int(rest.split("-")[0]) < bases[-2] or kind == "delta" and int(rest.split("-")[0]) == bases[-2]):
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(buckets)).cast("int")


def host_table(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, schemas.HOSTS, "fqdn")


def queue_table(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, schemas.QUEUE, "id", "url")


def job_table(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, schemas.JOB_MARKS, "job_id")


def busy_table(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, schemas.BUSY_KEYS, "key")


def loop_table(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, schemas.LOOP_ROWS, "id")


def count_table(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, schemas.PATTERN_COUNTS, "id")


def start(rows: DataFrame, batch: Batch, checkpoint: str, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def keep_changes(rows: Versions, stream: str = "loop") -> Batch:
    """Keeps the last of each changed row(key, opened, ...) of a queue loop."""

    def run(batch: DataFrame, number: int) -> None:
        with rows.turn():
            if number > rows.applied(stream):
                rows.change(batch.withColumn("id", S.stable_id("key", "opened")), stream, number)

    return run


def _count(counts: Versions | None, old: DataFrame | None, new: DataFrame, stream: str, number: int) -> None:
    """Adds what a batch changes in hosts to the counts of their patterns."""
    if counts is not None and number > counts.applied(stream):
        changes = rollup.signed_counts(old, new)
        counts.change(rollup.added(counts.read(keys=changes), changes), stream, number)


def fold_discoveries(hosts: Versions, counts: Versions | None = None, stream: str = "discoveries") -> Batch:
    """Upserts each batch of observations into the table of hosts, and keeps up the counts of patterns; a batch that comes again is passed over.

    Only the hosts that the batch names are read.
    """
    last = counts or hosts

    def run(batch: DataFrame, number: int) -> None:
        with hosts.turn(), last.turn():
            if number <= last.applied(stream):
                return
            was = hosts.before(stream, number)
            old = hosts.read(was, keys=batch)
            new = fold.upsert_hosts(old, batch)
            if number > hosts.applied(stream):
                hosts.change(new, stream, number)
            _count(counts, old, new, stream, number)

    return run


def ingest_certificates(hosts: Versions, queue: Versions, patterns: DataFrame, as_of: Column, counts: Versions | None = None, stream: str = "certificates") -> Batch:
    """Inserts hosts of matched certificate URLs, keeps up the counts of patterns and offers the URLs to the queue; the tables may have other streams too."""

    def run(batch: DataFrame, number: int) -> None:
        with hosts.turn(), (counts or hosts).turn(), queue.turn():
            if number <= queue.applied(stream):
                return
            # a batch that wrote its hosts but not its queue starts from the hosts before it
            known = hosts.read(hosts.before(stream, number), keys=batch.withColumn("fqdn", S.url_host("url")))
            known = batch.sparkSession.createDataFrame([], hosts.schema) if known is None else known
            waiting = queue.read(keys=batch)
            waiting = batch.sparkSession.createDataFrame([], queue.schema) if waiting is None else waiting
            done = match.ingest_certificates(batch, patterns, known, waiting, as_of)
            if number > hosts.applied(stream):
                hosts.change(done["new_hosts"], stream, number)
            _count(counts, None, done["new_hosts"], stream, number)
            queue.change(done["offers"], stream, number)

    return run


def fold_job_states(jobs: Versions, stream: str = "jobs") -> Batch:
    """Folds status events into the marks of their jobs."""

    def run(batch: DataFrame, number: int) -> None:
        with jobs.turn():
            if number > jobs.applied(stream):
                jobs.change(fold.fold_job_marks(jobs.read(keys=batch), batch), stream, number)

    return run


def admit_events(busy: Versions, admitted: str, stream: str = "admission") -> Batch:
    """Writes the admitted enqueues of each batch of events(key, seq, kind) to a folder of the batch, and which keys are busy after it.

    Batches come in the order of seq, as far as a key is concerned.
    """

    def run(batch: DataFrame, number: int) -> None:
        with busy.turn():
            if number > busy.applied(stream):
                first, after = workqueue.admit_after(busy.read(keys=batch), batch)
                first.write.mode("overwrite").parquet(f"{admitted}/batch={number}")
                busy.change(after, stream, number)

    return run


def digest_job_states(jobs: Versions, digests: str, known: DataFrame, stats: DataFrame, as_of: Column) -> Batch:
    """Folds status events and writes a digest payload for each job that a batch completes, in a folder of the batch."""
    keep = fold_job_states(jobs)

    def run(batch: DataFrame, number: int) -> None:
        keep(batch, number)
        done = batch.filter("status = 'completed'").select(F.col("job_id").alias("id")).distinct()
        finished = known.drop("status").join(done, "id", "left_semi").withColumn("status", F.lit("completed"))
        told = payloads.digest_payload(job_ops.job_digests(finished, stats, as_of), "discovery", as_of)
        told.write.mode("overwrite").json(f"{digests}/batch={number}")

    return run


def process_scans(queue: Versions, hosts: Versions, alerts: str, patterns: DataFrame, workers: int, as_of: Column, stream: str = "scans") -> Batch:
    """Settles a batch of scan results(seq, queue_id, http_status, body, at), alerts, recovers stale rows and claims the next.

    Alerts are written to a folder of the batch, with the ids of their queue rows: one for each row found by certificates
    whose scan went well at a host that was unreachable. The queue's version is written last, so a batch cut short runs again in full.
    """

    def run(batch: DataFrame, number: int) -> None:
        with hosts.turn(), queue.turn():
            if number <= queue.applied(stream):
                return
            rows, was = queue.read(), hosts.before(stream, number)
            results = feeds.classify_scans(batch).withColumnRenamed("queue_id", "id")
            scanned = results.join(rows.select("id", "url", "host_id", "source"), "id")
            known = hosts.read(was, scanned.select(S.url_host("url").alias("fqdn")))
            alive = lifecycle.apply_scans(scanned.select("seq", "host_id", "outcome", "at"), known)
            found = scanned.filter("outcome = 'ok' and source = 'certificate'").join(known.select(F.col("id").alias("host_id"), "status", "pattern_id"), "host_id").filter("status = 'unreachable'")
            value = patterns.select(F.col("id").alias("pattern_id"), F.col("value").alias("pattern_value"))
            parts = {c: F.to_json(F.try_variant_get(S.json_value("body"), f"$.{c}", "variant")) for c in ("chain", "technologies", "metadata")}
            told = payloads.alert_payload(found.join(value, "pattern_id").withColumns(parts), as_of, "id")
            told.write.mode("overwrite").json(f"{alerts}/batch={number}")
            if number > hosts.applied(stream):
                hosts.change(alive, stream, number)
            settled = workqueue.settle(rows, results.select("id", "outcome"), as_of)
            claimed = workqueue.claim(workqueue.recover(settled, as_of), workers, as_of)
            queue.change(claimed.filter(F.col("updated_at") == as_of), stream, number)  # every change sets the time

    return run


def distinct_urls(urls: DataFrame, at: str = "at", delay: str = "1 day") -> DataFrame:
    """A stream of URLs without repeats that arrive within the delay."""
    return urls.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(["url"])


def daily_activity(events: DataFrame, at: str = "at", delay: str = "1 day") -> DataFrame:
    """(day, kind, n): events a day; batch and stream alike."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, delay) if timed.isStreaming else timed
    return timed.groupBy(F.window(at, "1 day")["start"].alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))


def hosts_by_certificate(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """A stream of URLs with the host and first matching pattern: a stream-static equi-join on suffixes."""
    wanted = patterns.filter("active").select(F.col("id").alias("pattern_id"), "value", F.col("created_at").alias("pattern_created_at"))
    named = urls.withColumn("fqdn", S.url_host("url")).filter("fqdn <> ''")
    return named.withColumn("value", F.explode(match.suffix_patterns("fqdn"))).join(wanted, "value")
