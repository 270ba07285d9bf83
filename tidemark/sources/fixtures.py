"""Inventory tables derived from the driver's tables by column rules, so that queries grow with their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.fold import upsert_hosts
from ..operators.match import match_hosts

AS_OF = "TIMESTAMP '2024-02-01'"
START = "TIMESTAMP '2024-01-01'"
PATTERN_ROWS = [
    ("1", "*.example.com", True), ("2", "*.example.net", True), ("3", "*.example.org", True),
    ("4", "*.nohost.example.edu", True), ("5", "*.tionsh.example.com", True), ("6", "*.inactive.example.net", False),
]


def as_of() -> F.Column:
    return F.expr(AS_OF)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, a folder or one file, as a stream of its files."""
    reader, file = spark.readStream.schema(load(spark, sf_dir, name).schema), f"{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{file}")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", file).parquet(sf_dir)
    return reader.parquet(f"{sf_dir}/{file}")


def after(minutes: F.Column, seconds: F.Column | None = None) -> F.Column:
    zero = F.lit(0)
    return F.expr(START) + F.make_interval(zero, zero, zero, zero, zero, minutes.cast("int"), F.lit(0) if seconds is None else seconds.cast("int"))


def patterns(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PATTERN_ROWS, "id string, value string, active boolean")
    return rows.withColumn("created_at", after(F.col("id").cast("int")))


def tracked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern for every supplier; those in debt are inactive."""
    key = F.col("s_suppkey")
    value = F.concat(F.lit("*.s"), key, F.lit(".example.com"))
    return load(spark, sf_dir, "supplier").select(key.cast("string").alias("id"), value.alias("value"), (F.col("s_acctbal") > 0).alias("active"), after(key % 997).alias("created_at"))


def customer_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, fqdn): a host name for every customer, most below a supplier's pattern."""
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(key.alias("seq"), F.concat(F.lit("c"), key, F.lit(".s"), key % 150 + 1, F.lit(".example.com")).alias("fqdn"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(load(spark, sf_dir, "pages").select("page_id", "url"))


def observed(p: DataFrame) -> DataFrame:
    """Observations of pages(page_id, url)."""
    n = F.col("page_id")
    ip = F.when(n % 10 != 0, F.concat(F.lit("10.0.0."), n % 250))
    ports = F.when(n % 7 == 0, None).when(n % 3 == 0, '{"tcp":{"22":{"web":null}},"udp":{}}').otherwise(F.concat(F.lit('{"tcp":{"443":{"web":"'), "url", F.lit('"}},"udp":{}}')))
    rows = p.select(n.alias("seq"), "url", S.url_host("url").alias("fqdn"), ip.alias("ip"), F.lit(None).cast("string").alias("cdn"), ports.alias("ports"), after(n).alias("observed_at"))
    cname = F.when(F.col("seq") % 4 == 0, F.array(F.concat(F.lit("cdn."), "fqdn")))
    return rows.withColumn("dns", F.to_json(F.struct(F.when(F.col("ip").isNotNull(), F.array("ip")).alias("A"), cname.alias("CNAME"))))


def matched_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(observations(spark, sf_dir))


def matched(seen: DataFrame) -> DataFrame:
    return seen.join(match_hosts(seen, patterns(seen.sparkSession)), "fqdn", "left")


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = upsert_hosts(None, matched_observations(spark, sf_dir))
    return folded.withColumn("updated_at", as_of())


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("size"))
    n = F.col("page_id")
    code = F.when(n % 8 == 3, 301).when(n % 8 == 4, 302).when(n % 8 == 5, 404).when(n % 8 == 6, 403).when(n % 8 == 7, 500).otherwise(200)
    last = F.format_string('{"url":"%s","title":"Page %d","status_code":%d,"response_size":%d}', "url", n, F.when(code.isin(301, 302), 200).otherwise(code), "size")
    first = F.format_string('{"url":"%s","title":"","status_code":%d,"response_size":0}', "url", code)
    chain = F.when(code.isin(301, 302), F.concat(F.lit("["), first, F.lit(","), last, F.lit("]"))).otherwise(F.concat(F.lit("["), last, F.lit("]")))
    tech = F.when(n % 4 == 0, '[{"name":"Kestrel","version":""},{"name":"Elixir","version":"1.17"}]').when(n % 4 == 1, '[{"name":"Svelte","version":"5"}]').when(n % 4 == 2, "[]")
    fqdn = S.url_host("url")
    meta = F.when(n % 5 == 0, F.concat(F.lit('{"favicon":"https://'), fqdn, F.lit('/favicon.ico","lang":"en"}'))).otherwise('{"lang":"en"}')
    external = F.when(n % 6 == 0, '["a.example.com","b.example.com"]').otherwise("[]")
    return p.select(
        n.cast("string").alias("id"), S.stable_id(fqdn).alias("host_id"), "url", chain.alias("chain"), tech.alias("technologies"), F.lit("{}").alias("cookies"), meta.alias("metadata"),
        external.alias("external_hosts"), F.when(n % 13 != 0, after(n)).alias("scanned_at"), after(n).alias("created_at"),
    )


def small_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages").groupBy(S.url_host("url").alias("fqdn")).agg(F.min("page_id").alias("n"))
    return p.select(
        S.stable_id("fqdn").alias("id"), "fqdn", (F.col("n") % 4 + 1).cast("string").alias("pattern_id"), F.when(F.col("n") % 3 == 0, "dead").otherwise("alive").alias("status"),
        after(F.col("n")).alias("created_at"), after(F.col("n") + 5).alias("updated_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    status = F.when(n % 500 == 0, "pending").when(n % 500 == 1, "running").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "timeout").otherwise("completed")
    o = o.withColumn("status", status)
    started = F.when(F.col("status") != "pending", after(n % 250 + 1))
    ended = F.when(~F.col("status").isin("pending", "running"), after(n % 250 + 1, n % 7200))
    return o.select(
        n.cast("string").alias("id"), (F.col("o_custkey") % 4 + 1).cast("string").alias("pattern_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "intensive").otherwise("normal").alias("mode"),
        "status", F.when(n % 3 != 0, F.concat(F.lit("ext-"), n)).alias("external_id"), started.alias("started_at"), ended.alias("completed_at"), after(n % 250).alias("created_at"),
    )


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_kinds(load(spark, sf_dir, "events"))


def queue_kinds(events: DataFrame) -> DataFrame:
    """Queue events of events(user_id, event_id, event_type, ts)."""
    kind = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "fail")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at")).filter("kind is not null")


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    t = F.col("event_type")
    kind = (
        F.when(i % 7 == 0, "dns_ok").when(i % 11 == 0, "ok").when(t == "purchase", "alive").when(t == "click", "unreachable").when(t == "signup", "certificate").when(t == "error", "fail").otherwise("dns_fail")
    )
    host_type = F.element_at(F.array(F.lit("web"), F.lit("other"), F.lit("unknown")), (F.floor("value") % 3 + 1).cast("int"))
    source = F.when(i % 2 == 0, "certificate").otherwise("discovery")
    return e.select(F.col("user_id").alias("key"), i.alias("seq"), kind.alias("kind"), host_type.alias("type"), (i % 2 == 0).alias("answered"), source.alias("source"))


def probes(rows: DataFrame) -> DataFrame:
    n = F.length("fqdn")
    return rows.select("fqdn", (n % 4 != 0).alias("dns_ok"), F.when(n % 2 == 1, F.array(F.lit("22"))).otherwise(F.array().cast("array<string>")).alias("answered"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_kinds(load(spark, sf_dir, "events"))


def job_kinds(events: DataFrame) -> DataFrame:
    """Job status events of events(user_id, event_id, event_type, ts)."""
    t = F.col("event_type")
    status = F.when(t == "view", "running").when(t == "purchase", "completed").when(t == "error", "failed").when(t == "signup", "timeout").otherwise("pending")
    return events.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))
