"""Stored forms of the inventory: payload fields as typed columns, an index of technology names, bucketed tables.

Payloads are parsed once, when they are written: filters then reach the Parquet scan, and read the columns that they name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Runs of letters that the index of names holds; a search text of fewer letters than the longest is a run itself.
LONGEST_GRAM = 3


def write_services(services: DataFrame, path: str) -> None:
    """services with their payloads as VARIANT and what filters ask for as columns, rows of one status class together."""
    names = F.transform(S.technologies("technologies"), lambda t: t["name"])
    typed = services.select(
        "id", "host_id", "url", "scanned_at", "created_at",
        S.first_hop("chain", "status_code").alias("status_code"), S.status_class("chain").alias("status_class"), S.first_hop("chain", "title").alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("tech_names"), *[S.json_value(c).alias(c) for c in ("chain", "technologies", "cookies", "metadata", "external_hosts")],
    )
    typed.sortWithinPartitions("status_class", "id").write.parquet(path)


def services_of_class(spark: SparkSession, path: str, status_class: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("status_class") == status_class)


def write_hosts(hosts: DataFrame, path: str) -> None:
    """hosts with their payloads as VARIANT below `hosts/`; (protocol, port, host_id) of every open port below `ports/`, in their order."""
    typed = hosts.select(*[S.json_value(c).alias(c) if c in ("dns", "ports") else F.col(c) for c in hosts.columns])
    typed.write.parquet(f"{path}/hosts")
    every = [hosts.select(F.lit(p).alias("protocol"), F.explode(F.transform(S.open_ports("ports", p), lambda n: n.try_cast("int"))).alias("port"), F.col("id").alias("host_id")) for p in ("tcp", "udp")]
    every[0].unionByName(every[1]).filter("port is not null").repartitionByRange("protocol", "port", "host_id").sortWithinPartitions("protocol", "port").write.parquet(f"{path}/ports")


def hosts_with_port(spark: SparkSession, path: str, port: int, protocol: str = "tcp") -> DataFrame:
    """The hosts with an open port: the scan of ports reads the row groups that hold it."""
    held = spark.read.parquet(f"{path}/ports").filter((F.col("protocol") == protocol) & (F.col("port") == port)).select(F.col("host_id").alias("id"))
    return spark.read.parquet(f"{path}/hosts").join(held, "id", "left_semi")


def _grams(name: Column) -> Column:
    """The distinct runs of one to three letters of a text."""

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, F.lit(n)))
        return F.when(F.length(name) >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, LONGEST_GRAM + 1)]))


def write_name_index(services: DataFrame, path: str) -> None:
    """An inverted index of technology names: `grams/` (gram, name), ordered by gram, and `postings/` (name, service_id), by name.

    Names are distinct and few beside the services that have them; their letters are lower case.
    """
    pairs = services.select(F.col("id").alias("service_id"), F.explode(F.transform(S.technologies("technologies"), lambda t: F.lower(t["name"]))).alias("name")).filter("name is not null").distinct()
    pairs.repartitionByRange("name", "service_id").sortWithinPartitions("name").write.parquet(f"{path}/postings")
    names = pairs.sparkSession.read.parquet(f"{path}/postings").select("name").distinct()
    names.select(F.explode(_grams(F.col("name"))).alias("gram"), "name").repartitionByRange("gram", "name").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def services_with_technology(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(id): the services with a technology whose name contains text, case ignored; an empty text is in every name.

    Names that hold all of the text's runs are candidates, which are then looked through; only postings are read.
    """
    wanted = text.lower()
    postings = spark.read.parquet(f"{path}/postings")
    if wanted:
        size = min(LONGEST_GRAM, len(wanted))
        runs = sorted({wanted[i : i + size] for i in range(len(wanted) - size + 1)})
        held = spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(runs)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        names = held.filter((F.col("n") == len(runs)) & F.contains("name", F.lit(wanted))).select("name")
        postings = postings.join(names, "name", "left_semi")
    return postings.select(F.col("service_id").alias("id")).distinct()


def save_bucketed(rows: DataFrame, key: str, path: str, buckets: int = 8) -> str:
    """rows as a table in buckets of key, each a sorted file below path; the table's name.

    Joins and folds by the key then take the stored side as it lies; buckets should follow the size, and be alike in tables that meet.
    """
    name = f"stored_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


def upsert_stored(stored: DataFrame, new: DataFrame, key: str, first: tuple[str, ...], last: tuple[str, ...], seq: str = "seq", buckets: int = 8) -> DataFrame:
    """As `fold.upsert`, by a join with the stored table: only the new rows are dealt out, to the buckets in which their keys are stored.

    first columns of the earliest record of a key, last columns of its latest; stored rows come before new ones.
    """
    folded = new.groupBy(key).agg(F.min_by(F.struct(*first), seq).alias("__first"), F.max_by(F.struct(*last), seq).alias("__last"))
    held = stored.select(key, F.struct(*first).alias("__held_first"), F.struct(*last).alias("__held_last"))
    joined = held.join(folded.repartition(buckets, key), key, "full")
    return joined.select(key, F.coalesce("__held_first", "__first").alias("f"), F.coalesce("__last", "__held_last").alias("l")).select(key, "f.*", "l.*")
