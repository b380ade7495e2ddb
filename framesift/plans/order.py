"""Global row positions without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from framesift.plans.shared import write_shared


def with_position(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the 0-based position in the order: ranges are sorted apart, and each adds the counts of those before.

    Only one count per range is gathered.  The ranges are a written table, so positions do not depend on a re-run.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = write_shared(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).select(F.col("_range").alias("_of"), "_before")
    within = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1)
    placed = within.join(F.broadcast(sizes), F.col("_range") == F.col("_of"))
    return placed.withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_of", "_before", "_in")
