"""Folders for what jobs write on their way, readable by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def is_local(master: str) -> bool:
    """Whether a master runs everything in one process."""
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    It has to be named there; only where everything runs on one machine a temporary one does.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not is_local(context.master):
                raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder and what is in it, whatever file system it is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
