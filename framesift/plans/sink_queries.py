"""Sinks, upkeep and conversions of the given tables, written and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import paths
from framesift.operators import boxes as B, merge as M, sequence as seq, tags as T
from framesift.plans import fixtures as fx
from framesift.plans.registry import query, table
from framesift.plans.scene_queries import KEYED
from framesift.plans.shared import shared_path, write_shared
from framesift.sources import label_files as L, writers as K


@query("k7_label_lines", f"""WITH {fx.BOXES}, n AS (SELECT image_id, concat('img', supp) AS name, list_position(['A', 'N', 'R'], cls) - 1 AS c, (least(x1, 1920) + x0) / 2 / 1920 AS cx, (least(y1, 1080) + y0) / 2 / 1080 AS cy, (least(x1, 1920) - x0) / 1920 AS w, (least(y1, 1080) - y0) / 1080 AS h FROM boxes)
 SELECT CASE WHEN ('0x' || substr(md5(name), 1, 8))::BIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split, name, concat(c, ' ', round(cx * 64)::INT, ' ', round(cy * 64)::INT, ' ', ceil(w * 64)::INT, ' ', ceil(h * 64)::INT) AS line, count(*) AS n FROM n GROUP BY ALL""")
def k7_label_lines(spark, d):
    """Label files of one image a supplier, written by tasks and read back line by line; the boxes in 64ths of the image."""
    path = shared_path(spark, "label-files")
    c = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("cls")) - 1
    x1, y1 = F.least("x1", F.lit(1920.0)), F.least("y1", F.lit(1080.0))
    places = [F.round((x1 + F.col("x0")) / 2 / 1920 * 64), F.round((y1 + F.col("y0")) / 2 / 1080 * 64), F.ceil((x1 - F.col("x0")) / 1920 * 64), F.ceil((y1 - F.col("y0")) / 1080 * 64)]
    line = F.concat_ws(" ", c.cast("string"), *[p.cast("int").cast("string") for p in places])
    name = F.concat(F.lit("img"), F.col("supp").cast("string"))
    files = fx.boxes(spark, d).select(name.alias("name"), line.alias("line")).groupBy("name").agg(F.collect_list("line").alias("lines"))
    L.write_label_files(files.withColumn("split", paths.hash_split(F.col("name"))), ["A", "N", "R"], path)
    read = spark.read.option("recursiveFileLookup", "true").text(f"{path}/labels").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return read.groupBy(F.regexp_extract("file", "/labels/([^/]+)/", 1).alias("split"), paths.stem(F.col("file")).alias("name"), "line").agg(F.count("*").alias("n"))


@query("k2_json_array", f"WITH {fx.ASSETS} SELECT asset_id, project, status, lang, n_chars FROM assets")
def k2_json_array(spark, d):
    path = shared_path(spark, "json-array")
    K.write_json_array(fx.assets(spark, d).select("asset_id", "project", "status", "lang", "n_chars"), path)
    return K.read_json_array(spark, path, "asset_id string, project string, status string, lang string, n_chars bigint")


@query("m3_partitioned", """SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders UNION ALL SELECT -o_orderkey, 'N', 1.5 FROM orders WHERE o_orderkey % 500 = 7""")
def m3_partitioned(spark, d):
    """Two upserts of a few keys as deltas, compacted into the partitions they touch."""
    path, part = shared_path(spark, "orders"), F.expr("abs(o_orderkey) div 10000")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    few = orders.where("o_orderkey % 500 = 7")
    M.write_base(orders, path, part)
    M.add_delta(few.select("o_orderkey", F.lit("W").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice")), path, part, 1)
    late = few.select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    M.add_delta(late.unionByName(few.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"))), path, part, 2)
    M.compact(spark, path, orders.schema, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return M.merged(spark, path, orders.schema, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("t12_ontology_edits", """SELECT 'alias' AS kind, 'seg' AS dim, lower(c_mktsegment) AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'AUTOMOBILE' ELSE c_mktsegment END AS target FROM (SELECT DISTINCT c_mktsegment FROM customer)
  UNION ALL SELECT 'alias', 'seg', 'cars', 'AUTOMOBILE' UNION ALL SELECT 'dismissed', 'prio', o_orderpriority, NULL FROM (SELECT DISTINCT o_orderpriority FROM orders) WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT 'dismissed', 'prio', 'new', NULL""")
def t12_ontology_edits(spark, d):
    """One alias more, one with a new target, a candidate given up twice, and one restored."""
    segments = table(spark, d, "customer").select(F.lit("seg").alias("dim"), F.col("c_mktsegment").alias("value")).distinct()
    aliases = segments.select("dim", F.lower("value").alias("alias"), "value")
    for alias in ("cars", "machinery"):
        aliases = T.alias_added(segments, aliases, "seg", alias, "AUTOMOBILE")
    given_up = table(spark, d, "orders").select(F.lit("prio").alias("dim"), F.col("o_orderpriority").alias("tag")).distinct()
    given_up = T.restored(T.dismissed(T.dismissed(given_up, "prio", "new"), "prio", "new"), "prio", "1-URGENT")
    return aliases.select(F.lit("alias").alias("kind"), "dim", F.col("alias").alias("name"), F.col("value").alias("target")).unionByName(given_up.select(F.lit("dismissed").alias("kind"), "dim", F.col("tag").alias("name"), F.lit(None).cast("string").alias("target")))


GOST = "CASE p_size % 12 WHEN 9 THEN 'TrafficLight_red' WHEN 10 THEN ' x7' WHEN 11 THEN '3.24.' || (p_partkey % 9) ELSE (p_size % 9) || '_' || (p_partkey % 30) END"


@query("b1_gost_classes", f"""WITH c AS (SELECT p_partkey, {GOST} AS code FROM part), g AS (SELECT *, regexp_extract(replace(trim(code), '_', '.'), '^([0-9]+)', 1) AS g, replace(trim(code), '_', '.') AS n FROM c)
 SELECT p_partkey, code, CASE WHEN contains(lower(code), 'trafficlight') THEN 'traffic_light' WHEN starts_with(n, '3.24') AND g = '3' THEN 'speed_limit' WHEN g = '1' THEN 'warning' WHEN g = '3' THEN 'prohibition' WHEN g IN ('2', '4') THEN 'mandatory' WHEN g IN ('5', '6') THEN 'guide' END AS cls FROM g""")
def b1_gost_classes(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{GOST} AS code").withColumn("cls", B.gost_class(F.col("code")))


@query("b8_new_outputs", """WITH k AS (SELECT min(doc_id) AS doc_id, concat('cam_', doc_id // 3) AS key FROM documents GROUP BY doc_id // 3), known AS (SELECT concat('cam_', doc_id // 3) AS key FROM documents WHERE doc_id % 9 = 0)
 SELECT doc_id, key, CASE WHEN ('0x' || substr(md5(key), 1, 8))::BIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM k WHERE key NOT IN (SELECT key FROM known)""")
def b8_new_outputs(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), F.expr("cast(doc_id div 3 AS string)"), F.lit(".jpg")).alias("path"))
    known = files.where("doc_id % 9 = 0").select(F.concat(F.lit("cam_"), paths.stem(F.col("path"))).alias("key"))
    return B.new_outputs(files, known, "cam").select("doc_id", "key", "split")


@query("w7_rebuilt_clips", f"""WITH {KEYED.replace("WHERE id % 6 <> 5", "WHERE id % 6 <> 5 AND id % 2 = 0")}, w AS (SELECT *, count(*) OVER p AS total, first(path) OVER o AS head, (row_number() OVER o - 1) // 30 AS win FROM r WINDOW p AS (PARTITION BY run_id, mode, run_no), o AS (PARTITION BY run_id, mode, run_no ORDER BY value, sub, id)),
 g AS (SELECT run_id, mode, run_no, head, dir, win::INT AS clip_index, list(id ORDER BY value, sub, id) AS frame_ids FROM w WHERE total >= 5 GROUP BY ALL),
 s AS (SELECT 'seq_' || right(regexp_replace(head, '[^0-9A-Za-z_-]', '_', 'g'), 48) || '_' || lpad(clip_index::VARCHAR, 5, '0') || '_' || substr(md5(concat_ws('|', run_id, mode, run_no)), 1, 8) AS clip_id, 'seq:' || dir AS video_id, clip_index, frame_ids FROM g),
 v AS (SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 30)::INT AS clip_index, ts FROM events WHERE event_id % 2 = 1),
 vc AS (SELECT 'u' || user_id || '_' || lpad(clip_index::VARCHAR, 5, '0') AS clip_id, 'v/u' || user_id || '.mp4' AS video_id, clip_index, list(event_id ORDER BY ts, event_id) AS frame_ids FROM v GROUP BY user_id, clip_index)
 SELECT *, CASE WHEN len(frame_ids) = 30 THEN clip_id END AS vlm_result FROM (SELECT * FROM s UNION ALL SELECT * FROM vc)""")
def w7_rebuilt_clips(spark, d):
    """Odd events are frames of videos, even ones loose frames; old clips keep their result where their frames are the same."""
    odd = F.col("event_id") % 2 == 1
    times = table(spark, d, "events").select(F.col("event_id").alias("_e"), F.when(odd, F.concat(F.lit("v/u"), F.col("user_id").cast("string"), F.lit(".mp4"))).alias("video_path"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1000000D").alias("timestamp"), F.col("event_id").alias("frame_index"))
    frames = fx.frames(spark, d).join(times, F.col("id") == F.col("_e")).drop("_e")
    before = write_shared(seq.rebuild_clips(frames, spark.createDataFrame([], "clip_id string, frame_ids array<bigint>"), fields=[]), "old-clips")
    old = before.select("clip_id", F.when(F.size("frame_ids") == 30, F.col("frame_ids")).otherwise(F.slice("frame_ids", 2, 100)).alias("frame_ids"), F.col("clip_id").alias("vlm_result"))
    return seq.rebuild_clips(frames, old, fields=["vlm_result"])
