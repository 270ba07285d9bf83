"""Filtered, ordered and paged listings; one set of filters serves a page and its total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.schemas import HOST_STATUS, HOST_TYPE, JOB_STATUS, one_of

DEFAULT_PAGE, MAX_PAGE, DEFAULT_SIZE, MAX_SIZE = 1, 10_000, 50, 200


def clamp(page: object = None, per_page: object = None) -> tuple[int, int]:
    """Page and page size as whole numbers in range, bad ones replaced by the defaults."""

    def number(value: object, default: int) -> int:
        try:
            n = int(str(value))
        except ValueError:
            return default
        return n if n >= 1 else default

    return min(number(page, DEFAULT_PAGE), MAX_PAGE), min(number(per_page, DEFAULT_SIZE), MAX_SIZE)


def port_number(value: object) -> int | None:
    """A port from 1 to 65535, or None."""
    try:
        n = int(str(value))
    except ValueError:
        return None
    return n if 1 <= n <= 65535 else None


def filtered_hosts(hosts: DataFrame, pattern_id: str | None = None, status: str | None = None, type: str | None = None, port: object = None) -> DataFrame:
    """hosts that meet every condition given; None is no condition."""
    out = hosts
    if pattern_id is not None:
        out = out.filter(F.col("pattern_id") == pattern_id)
    if one_of(status, HOST_STATUS, "status") is not None:
        out = out.filter(F.col("status") == status)
    if one_of(type, HOST_TYPE, "type") is not None:
        out = out.filter(F.col("type") == type)
    if port is not None and port_number(port) is not None:
        out = out.filter(S.has_open_port("ports", port_number(port)))
    return out


def filtered_services(services: DataFrame, hosts: DataFrame, pattern_id: str | None = None, host_id: str | None = None, status_class: int | None = None, technology: str | None = None, like: bool = False) -> DataFrame:
    """services with the fqdn and pattern of their host, status_code and title; services without a host are left out."""
    out = services
    if host_id is not None:
        out = out.filter(F.col("host_id") == host_id)
    if status_class is not None:
        if status_class not in range(1, 6):
            raise ValueError(f"status_class must be 1 to 5, not {status_class!r}")
        out = out.filter(S.status_class("chain") == status_class)
    if technology is not None:
        out = out.filter(S.has_technology("technologies", technology, like))
    owner = hosts.select(F.col("id").alias("host_id"), "fqdn", "pattern_id")
    if pattern_id is not None:
        owner = owner.filter(F.col("pattern_id") == pattern_id)
    return out.join(owner, "host_id").withColumns({"status_code": S.first_hop("chain", "status_code"), "title": S.first_hop("chain", "title")})


def filtered_jobs(jobs: DataFrame, pattern_id: str | None = None, status: str | None = None) -> DataFrame:
    out = jobs
    if pattern_id is not None:
        out = out.filter(F.col("pattern_id") == pattern_id)
    if one_of(status, JOB_STATUS, "status") is not None:
        out = out.filter(F.col("status") == status)
    return out


def newest(column: str = "created_at") -> list[Column]:
    """Newest first, rows without a time last, ties by id."""
    return [F.desc_nulls_last(column), F.asc("id")]


def oldest(column: str = "created_at") -> list[Column]:
    return [F.asc(column), F.asc("id")]


def page(rows: DataFrame, order: list[Column], page: object = None, per_page: object = None) -> DataFrame:
    """One page of rows; only offset + size rows are kept in each task."""
    number, size = clamp(page, per_page)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, at: object, id: str, per_page: object = None, column: str = "created_at") -> DataFrame:
    """The rows after (at, id) in the order newest first: deep pages without an offset."""
    return rows.filter((F.col(column) < F.lit(at)) | ((F.col(column) == F.lit(at)) & (F.col("id") > id))).orderBy(*newest(column)).limit(clamp(1, per_page)[1])


def envelope(rows: DataFrame, order: list[Column], number: object = None, per_page: object = None) -> tuple[DataFrame, DataFrame]:
    """A page and its one-row envelope (total, page, per_page, page_count)."""
    p, size = clamp(number, per_page)
    head = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, order, p, size), head.select("total", F.lit(p).alias("page"), F.lit(size).alias("per_page"), F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("page_count"))


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the given keys, and the keys that have none."""
    return rows.join(keys.select(key).distinct(), key, "left_semi"), keys.join(rows.select(key), key, "left_anti")


def labelled(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows with pattern_label: the pattern's value, or the first eight characters of its id."""
    return rows.join(patterns.select(F.col("id").alias("pattern_id"), F.col("value").alias("__value")), "pattern_id", "left").withColumn("pattern_label", S.id_label("__value", "pattern_id")).drop("__value")


def placed(rows: DataFrame, group: str, block: Column, order: list[Column]) -> DataFrame:
    """rows with `place`, their number from 1 in their group: a group's rows are numbered block by block and moved on by the rows of earlier blocks.

    The order goes by block first, as times go by their hours, so that no task orders a whole group. Null groups are a group.
    """
    known = rows.withColumn("__block", block)
    sums = known.groupBy(F.col(group).alias("__group"), F.col("__block").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("__group", "__at", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy(group, "__block").orderBy(*order))
    moved = known.withColumn("__own", own).join(first, F.col(group).eqNullSafe(F.col("__group")) & F.col("__block").eqNullSafe(F.col("__at")))
    return moved.withColumn("place", (F.col("__own") + F.col("__first")).cast("int")).drop("__block", "__group", "__at", "__first", "__own")
