"""Lineage cut in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it is now, kept in ``spark.checkpoint.dir``; what follows isn't made again from the start when an
    executor is lost. Only where that is unset (a local test session) a temporary folder of this machine is named."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at ``path``, in whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
