"""Readers of the state tables and feeds; rows that a feed can't use go to a table of rejects with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import schemas

TABLES = {"patterns": schemas.PATTERNS, "hosts": schemas.HOSTS, "services": schemas.SERVICES, "jobs": schemas.JOBS, "queue": schemas.QUEUE}


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A state table; the schema is given, so no file is read to infer it."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_feed(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """A feed of JSON records, one a line, as a batch or a stream: the columns of the schema, `raw` and `broken`.

    raw is the line as it came, broken whether it can't be read by the schema; a broken line keeps no column. Blank lines are no records.
    """
    lines = (spark.readStream if streaming else spark.read).text(path).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}
    read = lines.select(F.col("value").alias("raw"), F.from_json("value", f"{schema}, __broken string", options).alias("record"))
    broken = F.col("record").isNull() | F.col("record.__broken").isNotNull()
    names = [c for c, _ in spark.createDataFrame([], schema).dtypes]
    return read.select(*[F.when(~broken, F.col(f"record.{c}")).alias(c) for c in names], "raw", broken.alias("broken"))


def read_discoveries(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The feed of discoveries with the fields of the host as columns."""
    return read_feed(spark, path, schemas.DISCOVERY_FEED, streaming).select("job_id", "host.*", "raw", "broken")


def _split(rows: DataFrame, reason: F.Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a reason to refuse them; lines that can't be read come first, with their text in `raw`."""
    if "broken" in rows.columns:
        reason = F.when(F.col("broken"), "broken record").otherwise(reason)
    judged = rows.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason", "raw", "broken"), judged.filter("reason is not null").drop("broken")


def accept_discoveries(feed: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Discovery records with the pattern of their job; rejected are those without a host name or with an unknown job."""
    known = jobs.select(F.col("id").alias("job_id"), "pattern_id")
    flat = feed.join(known, "job_id", "left")
    no_name = F.coalesce(F.col("fqdn"), F.lit("")) == ""
    return _split(flat, F.when(no_name, "no fqdn").when(F.coalesce(F.col("job_id"), F.lit("")) == "", "no job").when(F.col("pattern_id").isNull(), "unknown job"))


def accept_certificates(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certificate URLs with their host; rejected are those without one."""
    named = feed.withColumn("fqdn", S.url_host("url"))
    return _split(named, F.when(F.coalesce(F.col("fqdn"), F.lit("")) == "", "no host"))


def accept_job_events(feed: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status events of known jobs; `pending` and unknown states are refused."""
    known = jobs.select(F.col("id").alias("job_id"), F.lit(True).alias("known"))
    fine = F.col("status").isin("running", "completed", "failed", "timeout")
    good, bad = _split(feed.join(known, "job_id", "left"), F.when(~F.coalesce(fine, F.lit(False)), "bad status").when(F.col("known").isNull(), "unknown job"))
    return good.drop("known"), bad.drop("known")


def classify_scans(results: DataFrame) -> DataFrame:
    """results(http_status, body) with outcome ok or fail, error, and scanned_at (null for the zero time)."""
    body = S.json_value("body")
    error = F.coalesce(F.try_variant_get(body, "$.error", "string"), F.lit(""))
    failed = (F.col("http_status") != 200) | body.isNull() | (error != "")
    at = F.try_to_timestamp(F.try_variant_get(body, "$.scanned_at", "string"))
    return results.withColumns({"outcome": F.when(F.coalesce(failed, F.lit(True)), "fail").otherwise("ok"), "error": error, "scanned_at": F.when(F.year(at) > 1, at)})


def accept_manual_requests(requests: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scan requests(seq, url) of known hosts as offers; rejected are bad URLs and unknown hosts."""
    named = requests.withColumns({"fqdn": S.url_host("url"), "scheme": S.url_scheme("url")})
    known = named.join(hosts.select("fqdn", F.col("id").alias("host_id")), "fqdn", "left")
    bad = ~F.col("scheme").isin("http", "https") | (F.col("fqdn") == "")
    good, rejects = _split(known, F.when(F.coalesce(bad, F.lit(True)), "bad url").when(F.col("host_id").isNull(), "not found"))
    return good.select("seq", "url", "host_id", F.lit("manual").alias("source")), rejects.select("seq", "url", "reason")
