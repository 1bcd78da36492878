"""Session helpers: where lineage cuts and staged tables may be written."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="sparkmail-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def _staging_root(spark: SparkSession) -> str:
    return posixpath.join(shared_dir(spark), f"staged-{spark.sparkContext.applicationId}")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one staged table.

    All of an application's staged tables lie in one folder of its own.
    """
    return posixpath.join(_staging_root(spark), f"{name}-{uuid.uuid4().hex}")


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged. Results that are not read yet
    may still need it, so this is for the caller to decide."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(_staging_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
