"""Exact duplicates of documents, combined in salted steps that compare whole texts.

Texts are equal when identical after each run of white space became one space. The groups are found in three steps,
each keyed by digest and by the text itself: every task combines the copies among its own rows, salted digest groups
merge what tasks have left, and the winners of the salts are combined over all. A group of any size thus arrives at
a merging task as at most one row for each task before it.

Rows then learn of their group by digest, which says the text wherever the combined groups hold one text of that
digest; rows of a digest that stands for several texts are told apart by the text. Groups with more than a
thousandth of all rows, of which there are under a thousand, are broadcast; the others are joined by digest.

Null texts count as empty. The least id of a group stays; null ids come last, so that a group keeps a null id only
if it has no other. Of repeated rows of the id that stays one is kept. Empty tables give empty tables; other columns
of documents don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, written

#: Salts of one digest: a task that merges meets the rows of one in so many tasks.
SALTS = 16
#: Groups with more than this part of all rows are broadcast.
HOT_SHARE = 1000

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _texts(documents: DataFrame, id_col: str, text_col: str, digest: Digest) -> DataFrame:
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("text"))
    return rows.select("id", "text", digest(F.col("text")).alias("digest"))


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size): the distinct texts of rows(id, text, digest)."""
    salted = rows.withColumn("salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("digest", "salt", "text").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = merged.drop("salt").repartition("digest")
    return winners.groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def _one_kept(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `kept`, true for the least id of each group by keys."""
    order = Window.partitionBy(*keys).orderBy(F.col("id").asc_nulls_last())
    return rows.withColumn("kept", F.row_number().over(order) == 1)


def _one_kept_of_hot(rows: DataFrame) -> DataFrame:
    """As _one_kept, for groups of any size: only rows of the id that stays compete, first within their task."""
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    own = Window.partitionBy("digest", "task").orderBy("group_size")
    ranked = rows.filter(stays).withColumn("task", F.spark_partition_id()).withColumn("n", F.row_number().over(own)).drop("task")
    first = _one_kept(ranked.filter("n = 1").drop("n"), ["digest"])
    rest = ranked.filter("n > 1").drop("n").unionByName(rows.filter(~stays))
    return first.unionByName(rest.withColumn("kept", F.lit(False)))


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, hot_share: int = HOT_SHARE, digest: Digest = sha256) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256) of every row of documents, repeated rows included."""
    texts = _texts(documents, id_col, text_col, digest)
    groups = written(_combined(texts, salts).drop("text"))
    ids = written(documents.select(F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("text")).select("id", sha256(F.col("text")).alias("sha256"), digest(F.col("text")).alias("digest")))
    rows = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * hot_share > rows
    several = cut(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))
    if not several.isEmpty():
        shared = texts.join(several, "digest", "left_semi")
        told = shared.withColumn("sha256", sha256(F.col("text"))).join(_combined(shared, salts), ["digest", "text"])
        told = _one_kept(told, ["digest", "text"])
        groups, ids = (t.join(several, "digest", "left_anti") for t in (groups, ids))
    large = F.broadcast(groups.filter(hot))
    found = _one_kept(ids.join(large, "digest", "left_anti").join(groups.filter(~hot), "digest"), ["digest"])
    found = found.unionByName(_one_kept_of_hot(ids.join(large, "digest")))
    if not several.isEmpty():
        found = found.unionByName(told.select(*found.columns))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One whole row of documents for each distinct text, that of the least id; which one of repeated rows of an id is not said."""
    order, row = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`")), F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(order.alias("at"), row.alias("row"), normalised(F.col(f"`{text_col}`")).alias("text"))
    salted = rows.withColumns({"digest": sha256(F.col("text")), "salt": F.spark_partition_id() % salts})
    merged = salted.groupBy("digest", "salt", "text").agg(F.min_by("row", "at").alias("row"), F.min("at").alias("at"))
    return merged.drop("salt").repartition("digest").groupBy("digest", "text").agg(F.min_by("row", "at").alias("row")).select("row.*")
