"""Small Spark helpers of the corpus operators: reading, checkpoints and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import checkpoint_folder, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder, so that later steps start from files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Parquet row groups of intermediate tables: a writer holds a whole one in memory.
BLOCK_BYTES = 16 << 20


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: as `cut`, for wide rows of which later steps read some columns."""
    path = shared_folder(df.sparkSession)
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows and bytes of one Arrow batch: texts may be long, and a worker holds a whole batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches limited to BATCH_ROWS rows and about BATCH_BYTES where they were larger.

    Spark reads these settings when a query runs, so they stay as they are set here.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not held.lstrip("-").isdigit() or not 0 < int(held) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of links (a, b): one row (id, comp) per linked id, comp the least id.

    Each round takes the least label among the neighbours and then the label of that label, so the
    rounds grow with the logarithm of the longest path. An empty table of links gives no rows.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("comp")))
    for _ in range(max_rounds):
        near = (
            both.join(label.select(F.col("id").alias("b"), F.col("comp").alias("seen")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("seen").alias("seen"))
        )
        step = label.join(near, "id").select("id", "comp", F.least("comp", "seen").alias("next"))
        jump = step.select("id", "comp", "next").join(
            label.select(F.col("id").alias("next"), F.col("comp").alias("far")), "next", "left"
        )
        new = cut(jump.select("id", F.col("comp").alias("old"), F.least("next", F.coalesce("far", "next")).alias("comp")))
        label = new.select("id", "comp")
        if new.filter(F.col("old") != F.col("comp")).isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
