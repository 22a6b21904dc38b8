"""Helpers shared by the corpus operators: the shared folder, written cuts, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, the separator of words in every operator here.
SPACE = r"[\x20\x09-\x0D]"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``; only where that is unset (a local test
    session) a temporary folder of this machine is made, once per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _local_dirs[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, and Spark plans the joins
    above it with the real size of the files.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as values.

    ``explode`` of a one-element array is a barrier for the optimizer: an expression used inside
    a lambda above it is computed once per row, not once per element.
    """
    packed = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.withColumn("_held", F.explode(F.array(packed))).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_held.{k}").alias(k) for k in columns])


def chunks_by_bytes(lengths: list[int], limit: int):
    """(from, to) ranges of rows of about ``limit`` bytes each; a longer row stands alone."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
