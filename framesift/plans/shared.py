"""Intermediate tables in the folder that every executor and the driver share.

A table written here cuts lineage: a lost executor costs a re-read, never a recomputation
of everything before it.  The folder is the one the session names in ``spark.checkpoint.dir``;
only where that is unset in a plain local session does this module choose one itself; on a cluster it raises.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``; on a local master, else one local folder per process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_FALLBACK:
        _LOCAL_FALLBACK.append(tempfile.mkdtemp(prefix="spark-framesift-"))
    return "file://" + _LOCAL_FALLBACK[0]


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; ``tag`` only makes it readable."""
    return f"{shared_dir(spark)}/framesift/{tag}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
