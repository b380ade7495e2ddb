"""Keyed upserts into a partitioned table that rewrite only the partitions they touch.

New rows land in delta folders, a write each; readers see base and deltas together.  Compaction reads the partitions that have deltas, merges them, and
replaces just these by dynamic partition overwrite, so the cost of an upsert follows its keys and not the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from framesift.operators.catalog import upserted
from framesift.plans.shared import write_shared

PART, ORDER = "part", "_version"


def write_base(rows: DataFrame, path: str, part: Column) -> None:
    """The table (all columns, and ``part``), clustered so that a partition has few files."""
    rows.withColumn(PART, part).repartition(PART).write.partitionBy(PART).parquet(f"{path}/base")


def add_delta(new: DataFrame, path: str, part: Column, version: int) -> None:
    """Rows of one upsert; a repeated version overwrites itself."""
    new.withColumn(PART, part).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/delta/{ORDER}={version}")


def _read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def _deltas(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key and partition: of each column the latest value that is not null."""
    rows = _read(spark, f"{path}/delta", T.StructType([*schema.fields, T.StructField(PART, T.LongType()), T.StructField(ORDER, T.LongType())]))
    rest = [c for c in schema.names if c not in keys]
    value = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ORDER))) if c in columns else F.min_by(c, ORDER) for c in rest}
    return rows.groupBy(PART, *keys).agg(*[v.alias(c) for c, v in value.items()])


def merged(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], columns: list[str]) -> DataFrame:
    """The table with all deltas: ``columns`` of a new row win where they have a value, new keys are added."""
    whole = T.StructType([*schema.fields, T.StructField(PART, T.LongType())])
    return upserted(_read(spark, f"{path}/base", whole), _deltas(spark, path, schema, keys, columns), [PART, *keys], columns).select(*schema.names)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], columns: list[str]) -> list[int]:
    """Merges the deltas into the base and returns the partitions that were rewritten; no other file is read or touched.

    The partitions' numbers reach the driver, as they do in any listing of the table.  Deltas are removed only after the base has been replaced,
    and merging them twice gives the same rows, so an interrupted compaction is repeated.
    """
    whole = T.StructType([*schema.fields, T.StructField(PART, T.LongType())])
    new = write_shared(_deltas(spark, path, schema, keys, columns), "deltas")
    touched = sorted(r[PART] for r in new.select(PART).distinct().collect())
    if touched:
        old = _read(spark, f"{path}/base", whole).where(F.col(PART).isin(touched))
        rows = write_shared(upserted(old, new.select(*whole.names), [PART, *keys], columns), "compacted")
        rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{path}/base")
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/delta")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
