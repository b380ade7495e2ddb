"""Sinks: export formats, label files, shards and snapshots.  A dataset is a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from framesift.functions.paths import safe_class_name
from framesift.operators.aggregates import manifest
from framesift.operators.search import export_rows, flat_rows, sharded_name
from framesift.plans.shared import write_shared

BYTE_ORDER_MARK = "\ufeff"
FORMATS = ("jsonl", "json", "csv", "parquet", "package")


def write_export(assets: DataFrame, path: str, form: str, dims: list[str]) -> dict:
    """Export assets in a format in one pass over them; returns path, format, the count of rows written and the manifest (a DataFrame).

    ``jsonl`` has a row a line, ``json`` one array over the dataset's files in their order.  A table without rows becomes an empty CSV file.
    """
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")
    seen = Observation()
    nested = export_rows(assets.observe(seen, F.count(F.lit(1)).alias("n")), dims)
    if form == "jsonl":
        nested.write.json(path)
    elif form == "json":
        write_json_array(nested, path)
    elif form == "csv":
        flat = flat_rows(nested, dims)
        # the mark that opens a UTF-8 file for spreadsheets stands before the header's first name
        flat.withColumnRenamed(flat.columns[0], BYTE_ORDER_MARK + flat.columns[0]).write.option("header", "true").csv(path)
        if not seen.get["n"]:
            assets.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(path)
    elif form == "parquet":
        flat_rows(nested, dims).write.parquet(path)
    else:
        nested.write.json(f"{path}/metadata")
        manifest(assets).write.json(f"{path}/manifest")
        assets.select("asset_id", "image_path", sharded_name(F.col("asset_id"), F.col("image_path")).alias("target")).write.parquet(f"{path}/files")
    return {"path": path, "format": form, "count": seen.get["n"], "manifest": manifest(assets)}


def write_json_array(rows: DataFrame, path: str) -> None:
    """One JSON array, dealt over text files whose concatenation in the order of their names is the document."""
    spark = rows.sparkSession
    lines = write_shared(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), "json-lines").withColumn("_n", F.monotonically_increasing_id())
    first = lines.agg(F.min("_n")).first()[0]
    body = lines.select(F.concat(F.when(F.col("_n") == F.lit(first), "").otherwise(","), F.col("value")).alias("value"))
    ends = [spark.range(0, 1, 1, 1).select(F.lit(c).alias("value")) for c in "[]"]
    ends[0].union(body).union(ends[1]).write.text(path)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The rows of ``write_json_array``."""
    lines = spark.read.text(path).where("value NOT IN ('[', ']')")
    return lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("_r")).select("_r.*")


def write_labels(labels: DataFrame, classes: DataFrame, path: str) -> None:
    """Label lines (split, name, lines) below one folder a split, and the class table."""
    labels.select("split", "name", F.array_join("lines", "\n").alias("text")).write.partitionBy("split").parquet(f"{path}/labels")
    classes.write.json(f"{path}/classes")


def new_shard_rows(rows: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Rows with their shard (the first character of the id), less those of equal id and size."""
    marked = rows.withColumn("shard", F.substring(F.col("id").cast("string"), 1, 1))
    return marked if existing is None else marked.join(existing.select("id", "size"), ["id", "size"], "left_anti")


def write_shards(rows: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    new_shard_rows(rows, existing).write.mode("append").partitionBy("shard").parquet(path)


def write_by_class(rows: DataFrame, path: str, cls: str = "cls") -> DataFrame:
    """Rows below a folder for each safe class name; returns the counts, which are written beside."""
    named = rows.withColumn("class_name", safe_class_name(F.col(cls)))
    named.write.partitionBy("class_name").parquet(f"{path}/data")
    counts = named.groupBy("class_name").agg(F.count("*").alias("n"))
    counts.write.json(f"{path}/counts")
    return counts


def project_path(root: str, project: str, kind: str) -> str:
    if kind not in ("raw", "processed", "inference", "metadata", "exports"):
        raise ValueError(f"no such folder: {kind}")
    return f"{root}/project={project}/{kind}"


def write_snapshot(rows: DataFrame, path: str, ts: str, key: str = "project") -> DataFrame:
    """Append a work list (project, id) under the time ``ts``, a folder for each project; returns its counts."""
    rows.select(F.col(key).cast("string").alias("project"), F.lit(ts).alias("ts"), "id").write.mode("append").partitionBy("project").parquet(path)
    return work_snapshot(rows, key)


def work_snapshot(rows: DataFrame, key: str = "project") -> DataFrame:
    """Per project the number of ids, the first and the last."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
