"""Readers: media listings, frame metadata, clips, catalogs and box annotations of several formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from framesift.functions.paths import basename, dirname, extension, stem
from framesift.operators.boxes import parse_label_lines
from framesift.operators.sequence import first_per_key

VIDEO = [".mp4", ".avi", ".mov", ".mkv", ".flv", ".wmv", ".ts", ".h264", ".h265"]
IMAGE = [".jpg", ".jpeg", ".png", ".bmp", ".webp"]


def media_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, dir, length, modified) of files with one of the extensions, any case; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(extension(F.col("path")).isin(extensions)).select("path", dirname(F.col("path")).alias("dir"), "length", F.col("modificationTime").alias("modified"))


def frame_records(records: DataFrame, position: str = "position") -> DataFrame:
    """Frame metadata with a whole-number id and a path, the first of each id."""
    clean = records.withColumn("id", F.col("id").cast("string").try_cast("long")).where("id IS NOT NULL AND coalesce(path, '') <> ''")
    return first_per_key(clean, ["id"], [position])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame records of a metadata file, one JSON list."""
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<id:string,path:string,filename:string,frame_index:int,timestamp:double,src_dir:string>>")).alias("position", "r"))
    return frame_records(items.select("position", "r.*"))


def clip_list(text: Column) -> Column:
    """The clips of a JSON text that is a list, {"clips": [...]} or {"clips": {id: ...}}, as an array of variants."""
    doc = F.try_parse_json(text)
    listed = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.try_variant_get(doc, "$.clips", "array<variant>"))
    keyed = F.map_values(F.try_variant_get(doc, "$.clips", "map<string,variant>"))
    return F.coalesce(listed, keyed)


def catalog_rows(assets: DataFrame, projects: DataFrame) -> DataFrame:
    """Catalog rows with their project's name and the video of their metadata text, by vector id within a project."""
    p = projects.select(F.col("id").alias("_p"), F.col("name").alias("project"))
    joined = assets.join(p, F.col("project_id") == F.col("_p")).withColumn("video_path", F.get_json_object("asset_metadata", "$.video_source.video_path"))
    return joined.drop("_p").orderBy("project", "vector_id")


def label_files(spark: SparkSession, root: str) -> DataFrame:
    """Box labels of text files, one file an image."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select("value", stem(F.col("_metadata.file_path")).alias("image_id"))
    return parse_label_lines(lines)


def coco_boxes(doc: DataFrame) -> DataFrame:
    """Boxes of COCO documents (images, annotations, categories as arrays)."""
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("_i"), F.col("i.file_name").alias("image_id"), F.col("i.width").alias("img_w"), F.col("i.height").alias("img_h"))
    names = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("_c"), F.col("c.name").alias("cls"))
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", "a.bbox").withColumnRenamed("image_id", "_image")
    joined = boxes.join(images, F.col("_image") == F.col("_i")).join(names, F.col("category_id") == F.col("_c"))
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    return joined.select("image_id", "img_w", "img_h", "cls", x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"


def nested_detections(samples: DataFrame) -> DataFrame:
    """Normalised boxes of samples with detections.detections[] (label, bounding_box xywh); images without any keep one row."""
    each = samples.select(basename(F.col("filepath")).alias("image_id"), F.explode_outer("detections.detections").alias("d"))
    return each.select("image_id", F.col("d.label").alias("cls"), F.col("d.bounding_box").alias("bbox"))


def struct_of_arrays(rows: DataFrame, key: str = "image_id", column: str = "objects") -> DataFrame:
    """Boxes of a struct of parallel arrays (category, bbox)."""
    zipped = F.arrays_zip(F.col(f"{column}.category").alias("category"), F.col(f"{column}.bbox").alias("bbox"))
    return rows.select(key, F.explode(zipped).alias("o")).select(key, F.col("o.category").alias("cls"), F.col("o.bbox").alias("bbox"))


def array_of_structs(rows: DataFrame, key: str = "image_id", column: str = "objects") -> DataFrame:
    return rows.select(key, F.explode(column).alias("o")).select(key, F.col("o.category").alias("cls"), F.col("o.bbox").alias("bbox"))


def path_boxes(rows: DataFrame) -> DataFrame:
    """Boxes of rows keyed by ``image_path`` with ``bbox_coords`` as corner and size; the image is the path's last part."""
    x, y, w, h = (F.get("bbox_coords", F.lit(i)) for i in range(4))
    return rows.select(basename(F.col("image_path")).alias("image_id"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def latest_snapshot(spark: SparkSession, path: str, project: str) -> DataFrame:
    """(id, ts) of a project's last work list among those that ``write_snapshot`` left in ``path``."""
    own = spark.read.parquet(path).where(F.col("project") == project)
    last = own.agg(F.max("ts").alias("_last"))
    return own.join(F.broadcast(last), F.col("ts") == F.col("_last")).select("id", "ts")


TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("filename", "x_from", "y_from", "width", "height", "sign_class")])


def truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV truth with a header; rows with a bad number keep ``bad`` true, for counting."""
    rows = spark.read.schema(TRUTH).option("header", "true").option("mode", "PERMISSIVE").csv(path)
    x, y, w, h = (F.col(c).try_cast("double") for c in ("x_from", "y_from", "width", "height"))
    out = rows.select(F.col("filename").alias("image_id"), F.col("sign_class").alias("cls"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    return out.withColumn("bad", F.col("x1").isNull() | F.col("y1").isNull())


def image_objects(docs: DataFrame) -> DataFrame:
    """Visible boxes of per-image documents (width, height, objects[].label, bbox, properties)."""
    each = docs.select("image_id", "width", "height", F.explode("objects").alias("o"))
    seen = each.where(~F.coalesce("o.properties.exterior", F.lit(False)) & ~F.coalesce("o.properties.out-of-frame", F.lit(False)))
    return seen.select("image_id", F.col("width").alias("img_w"), F.col("height").alias("img_h"), F.col("o.label").alias("cls"), F.col("o.bbox.xmin").alias("x0"), F.col("o.bbox.ymin").alias("y0"), F.col("o.bbox.xmax").alias("x1"), F.col("o.bbox.ymax").alias("y1"))


def class_names(text: Column) -> Column:
    """Array of struct(id, name) of a class list text: lines of names numbered from 0."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x, i: F.struct(i.alias("id"), F.trim(x).alias("name")))


def quoted_class_names(text: Column) -> Column:
    """Array of struct(id, name) of ``12: 'name'`` pairs in a text."""
    ids = F.regexp_extract_all(text, F.lit(r"(\d+)\s*:\s*'([^']*)'"), 1)
    names = F.regexp_extract_all(text, F.lit(r"(\d+)\s*:\s*'([^']*)'"), 2)
    return F.zip_with(ids, names, lambda i, n: F.struct(i.cast("int").alias("id"), n.alias("name")))
