"""Lineage cuts on storage that survives the loss of an executor."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder spark.checkpoint.dir names; local sessions that name none get a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), "codelode-checkpoints")
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root(df.sparkSession))
    return df.checkpoint(eager=True)


def stamped(spark: SparkSession, label: str, source: str) -> str:
    """A folder for what is made of the files under source: another one once they have changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stamp = fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()
    return f"{root(spark)}/codelode-{label}-{hashlib.sha1(repr((fs.makeQualified(p).toString(), stamp)).encode()).hexdigest()[:16]}"
