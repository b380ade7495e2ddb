"""Discovery as a stream: a folder is watched, every round's outcomes are written to a manifest, and a restart goes on where the last run ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framesift.streaming.ingest import discovery_round

OUTCOMES = T.StructType([T.StructField("path", T.StringType()), T.StructField("dir", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("round", T.LongType())])


def media_stream(spark: SparkSession, folder: str, pattern: str, files: int) -> DataFrame:
    """(path, dir) of the files that appear below ``folder``, at most ``files`` a round; their bytes are never read."""
    found = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).load(folder)
    )
    return found.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest outcome of every path: a folder that was put off gets its own in a later round."""
    try:
        rows = spark.read.schema(OUTCOMES).parquet(f"{path}/*")
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], OUTCOMES)
    return rows.groupBy("path").agg(F.max_by(F.struct("dir", "outcome", "round"), "round").alias("_r")).select("path", "_r.*")


def _write_round(found: DataFrame, path: str, number: int, jobs: DataFrame, step: int, most: int) -> None:
    """One round over new files and those put off before; a repeated round overwrites its own folder and sees only what came before it."""
    spark = found.sparkSession
    known = manifest(spark, path).where(F.col("round") < number)
    waiting = known.where("outcome = 'later'")
    decided = known.where("outcome <> 'later'")
    rows = found.select("path", "dir").union(waiting.select("path", "dir")).distinct()
    first_run = not known.limit(1).count()
    told = discovery_round(rows, decided, jobs, step, most, first_run)
    told.withColumn("round", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/{number}")


def watch(found: DataFrame, path: str, checkpoint: str, jobs: DataFrame, step: int, most: int) -> None:
    """Takes what has arrived since the last call, a round for each micro-batch: the very first round only seeds the manifest below ``path``; later ones submit
    at most ``most`` folders and put the others off, to be looked at again with the next files."""
    query = found.writeStream.foreachBatch(lambda batch, number: _write_round(batch, path, number, jobs, step, most))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
