"""Further queries: catalog steps, readers, tags and reply fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import paths
from framesift.functions.jsontext import extracted_of
from framesift.operators import boxes as B, catalog as C, decision, dedup as D, normalize as N, sequence as seq, tags as T
from framesift.plans import fixtures as fx
from framesift.plans.registry import query, table
from framesift.plans.shared import shared_path, write_shared
from framesift.sources import readers as S, writers as K


@query("m5_stepped", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'FILTERED' ELSE 'REVIEW' END WHEN o_orderkey % 5 = 1 THEN 'TAGGED' WHEN o_orderkey % 5 = 2 THEN 'DETECTED' WHEN o_orderkey % 5 = 3 THEN 'EMBEDDED' ELSE 'SOURCE' END AS status FROM orders")
def m5_stepped(spark, d):
    o = table(spark, d, "orders")
    none = F.lit(None).cast("string")
    assets = o.select(F.col("o_orderkey").alias("id"), F.lit("SOURCE").alias("status"), F.lit(None).cast("long").alias("vector_id"), none.alias("detections"), none.alias("final_tags"), none.alias("decision"))
    k = F.col("o_orderkey") % 5
    name = F.when(F.col("o_orderstatus") == "F", "AUTO_PASS").when(F.col("o_orderstatus") == "O", "FILTER").otherwise("what")
    updates = o.select(F.col("o_orderkey").alias("id"), F.when(k == 3, F.col("o_custkey")).alias("vector_id"), F.when(k == 2, F.lit("{}")).alias("detections"), F.when(k <= 1, F.lit("{}")).alias("final_tags"), F.when(k == 0, name).alias("decision"))
    return C.stepped(assets, updates).select("id", "status")


def frame_records(spark, d):
    e = table(spark, d, "events")
    return e.select(F.when(F.col("event_id") % 50 == 0, F.lit("bad")).otherwise(F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("f/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"), F.lit("").alias("filename"), F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise(F.col("user_id").cast("string")).alias("frame_index"), F.col("value").cast("string").alias("timestamp"), F.concat(F.lit("v/"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("video_path"), F.when(F.col("event_id") % 2 == 0, F.lit("/abs")).otherwise(F.lit("rel")).alias("src_dir"))


@query("m11_synced", "SELECT event_id AS vector_id, event_id || '.jpg' AS filename, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END::INT AS frame_index, CASE WHEN event_id % 2 = 0 THEN '/abs' END AS source_root, CASE WHEN user_id < 50 THEN user_id END AS found_source FROM events WHERE event_id % 50 <> 0 AND event_id % 7 <> 0")
def m11_synced(spark, d):
    have = table(spark, d, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("vector_id"))
    sources = table(spark, d, "events").where("user_id < 50").select(F.col("user_id").alias("source_id")).distinct().withColumn("relative_path", F.concat(F.col("source_id").cast("string"), F.lit(".mp4")))
    return C.synced(have, frame_records(spark, d), sources).select("vector_id", "filename", "frame_index", "source_root", "found_source")


@query("m12_backfill_report", "SELECT count(*) AS meta, count(*) FILTER (event_id % 7 = 0) AS before, count(*) FILTER (event_id % 50 <> 0 AND event_id % 7 <> 0) AS added, count(*) FILTER (event_id % 50 = 0) AS gap FROM events")
def m12_backfill_report(spark, d):
    have = table(spark, d, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("vector_id"))
    return C.backfill_report(have, frame_records(spark, d))


@query("m13_renamed", "SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'Fresh name' WHEN c_custkey % 2 = 0 THEN c_name END AS display_name FROM customer")
def m13_renamed(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("display_name"))
    return C.renamed(p, 7, "Fresh name").select("id", "display_name")


@query("m14_human_labelled", "SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'old' END AS final_tags, CASE WHEN o_orderkey % 6 = 0 THEN 'AUTO_PASS' END AS decision FROM orders")
def m14_human_labelled(spark, d):
    o = table(spark, d, "orders")
    none = F.lit(None).cast("string")
    clips = o.select(F.col("o_orderkey").alias("clip_id"), none.alias("human_tags"), none.alias("human_rejected"), F.lit("old").alias("final_tags"), none.alias("decision"))
    labels = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("clip_id"), F.col("o_orderpriority").alias("human_tags"), none.alias("human_rejected"), none.alias("final_tags"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("AUTO_PASS")).alias("decision"))
    return C.human_labelled(clips, labels).select("clip_id", "final_tags", "decision")


@query("m25_appended", "SELECT substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 16) AS eval_id, l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'first', 0")
def m25_appended(spark, d):
    old = spark.range(1).select(F.lit("first").alias("eval_id"), F.col("id").alias("l_orderkey"))
    new = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return C.appended(old, new, "eval_id", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("m18_set_decision", "SELECT o_orderkey AS clip_id, CASE WHEN o_orderstatus = 'P' THEN 'REVIEW' END AS decision FROM orders")
def m18_set_decision(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.lit(None).cast("string").alias("decision"), "o_orderstatus")
    new = o.where("o_orderstatus = 'P'").select("clip_id", F.lit("REVIEW").alias("decision"))
    return C.upserted(o.select("clip_id", "decision"), new, ["clip_id"], ["decision"])


@query("m9_delete_by_names", "SELECT 'orders' AS child, count(*) AS n FROM orders WHERE o_custkey % 500 >= 50 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 500 < 50)")
def m9_delete_by_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("videos/v"), (F.col("o_custkey") % 500).cast("string"), F.lit(".mp4")).alias("path"))
    names = spark.range(50).select(F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(".mp4")).alias("name"))
    gone = C.suffix_match(o, names).select(F.col("o_orderkey").alias("key"))
    left = C.deleted({"orders": (o, "o_orderkey"), "lineitem": (table(spark, d, "lineitem"), "l_orderkey")}, gone)
    a, b = (t.agg(F.count("*").alias("n")).select(F.lit(n).alias("child"), "n") for n, t in left.items())
    return a.union(b)


@query("a17_round_summary", "SELECT source AS root, count(*) AS found, count(*) FILTER (doc_id % 3 <> 0) AS new, count(*) FILTER (doc_id % 3 = 1) AS submitted FROM documents GROUP BY ROLLUP (source)")
def a17_round_summary(spark, d):
    outcome = F.when(F.col("doc_id") % 3 == 0, "known").when(F.col("doc_id") % 3 == 1, "submit").otherwise("later")
    return C.round_summary(table(spark, d, "documents").select(F.col("source").alias("root"), outcome.alias("outcome")))


@query("f15_paired", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def f15_paired(spark, d):
    images = table(spark, d, "documents").select("doc_id", F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("stem"))
    return C.paired(images, images.where("doc_id % 3 = 0")).select("doc_id")


@query("f14_visible", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' AND NOT (l_returnflag = 'N' AND l_linestatus = 'O')")
def f14_visible(spark, d):
    from framesift.operators.search import visible

    out = F.when(F.col("l_returnflag") == "N", F.col("l_linestatus") == "O")
    return table(spark, d, "lineitem").where(visible(F.col("l_returnflag") == "R", out)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("l8_capped_total", "SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 300")
def l8_capped_total(spark, d):
    return C.capped_total(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"], 300)


@query("s4_catalog_rows", "SELECT o_orderkey AS vector_id, c_name AS project, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey END AS video_path FROM orders JOIN customer ON o_custkey = c_custkey")
def s4_catalog_rows(spark, d):
    meta = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"video_source": {"video_path": "v'), F.col("o_orderkey").cast("string"), F.lit('"}}')))
    assets = table(spark, d, "orders").select(F.col("o_orderkey").alias("vector_id"), F.col("o_custkey").alias("project_id"), meta.alias("asset_metadata"))
    return S.catalog_rows(assets, table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).select("vector_id", "project", "video_path")


@query("s7_nested_detections", "SELECT 'o' || o_orderkey || '.jpg' AS image_id, l_returnflag AS cls, l_discount AS x, l_tax AS y, l_quantity AS w, l_extendedprice AS h FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30")
def s7_nested_detections(spark, d):
    boxes = table(spark, d, "lineitem").where("l_quantity > 30").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("label"), F.array("l_discount", "l_tax", "l_quantity", "l_extendedprice").alias("bounding_box"))).alias("b"))
    o = table(spark, d, "orders")
    samples = o.join(boxes, o["o_orderkey"] == boxes["l_orderkey"], "left").select(F.concat(F.lit("d/o"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("filepath"), F.struct(F.col("b").alias("detections")).alias("detections"))
    return S.nested_detections(samples).select("image_id", "cls", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")])


@query("s9_array_of_structs", "SELECT l_orderkey AS image_id, l_returnflag AS cls, l_partkey AS x, l_suppkey AS y FROM lineitem")
def s9_array_of_structs(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("category"), F.array("l_partkey", "l_suppkey").alias("bbox"))).alias("objects"))
    return S.array_of_structs(rows).select("image_id", "cls", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(1)).alias("y"))


@query("s11_image_objects", "SELECT l_orderkey AS image_id, 10 AS img_w, 10 AS img_h, l_returnflag AS cls, l_partkey::DOUBLE AS x0, l_suppkey::DOUBLE AS y0, l_quantity AS x1, l_tax AS y1 FROM lineitem WHERE l_linestatus <> 'O'")
def s11_image_objects(spark, d):
    box = F.struct(*[F.col(c).cast("double").alias(n) for c, n in (("l_partkey", "xmin"), ("l_suppkey", "ymin"), ("l_quantity", "xmax"), ("l_tax", "ymax"))])
    props = F.struct((F.col("l_linestatus") == "O").alias("exterior"), F.lit(None).cast("boolean").alias("out-of-frame"))
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("label"), box.alias("bbox"), props.alias("properties"))).alias("objects")).withColumn("width", F.lit(10)).withColumn("height", F.lit(10))
    return S.image_objects(docs)


@query("s14_mixed_lines", f"WITH {fx.BOXES} SELECT image_id, CASE line % 3 WHEN 0 THEN 4 ELSE 2 END AS cls, CASE line % 3 WHEN 0 THEN 0.3 ELSE 0.5 END::DOUBLE AS cx, CASE line % 3 WHEN 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS cy, CASE line % 3 WHEN 0 THEN 0.4 ELSE 0.1 END::DOUBLE AS w, CASE line % 3 WHEN 0 THEN 0.3 ELSE 0.1 END::DOUBLE AS h FROM boxes WHERE line % 3 < 2")
def s14_mixed_lines(spark, d):
    value = F.expr("CASE line % 3 WHEN 0 THEN '4 0.1 0.1 0.5 0.1 0.5 0.4 0.1 0.4' WHEN 1 THEN '2 0.5 0.5 0.1 0.1' ELSE '2 0.5 0.5' END")
    parsed = B.parse_label_lines(fx.boxes(spark, d).select("image_id", value.alias("value")))
    return parsed.select("image_id", "cls", *[F.round(F.col("box")[c], 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("s15_store_counts", "SELECT source AS project, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL")
def s15_store_counts(spark, d):
    from framesift.operators.search import lookup

    store = table(spark, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("fid"))
    return lookup(store, store.where("fid % 2 = 0"), ["project", "fid"]).groupBy("project").agg(F.count("*").alias("n"))


@query("s12_path_boxes", "SELECT p_partkey || '.jpg' AS image_id, p_partkey AS x0, 1::BIGINT AS y0, p_partkey + p_size AS x1, 3::BIGINT AS y1 FROM part")
def s12_path_boxes(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("a/b/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image_path"), F.array(F.col("p_partkey"), F.lit(1).cast("long"), F.col("p_size").cast("long"), F.lit(2).cast("long")).alias("bbox_coords"))
    return S.path_boxes(rows)


@query("t3_human_tags", "SELECT c_custkey AS asset_id, c_mktsegment AS tag, 'Human' AS source, 1.0::DOUBLE AS confidence FROM customer")
def t3_human_tags(spark, d):
    return T.human_tags(table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_mktsegment").alias("tag")))


@query("t8_evidence_score", f"WITH {fx.DECISIONS} SELECT asset_id, round(CASE WHEN (CASE WHEN y > 0 THEN 0.3 ELSE 0 END + CASE WHEN d > 0 THEN 0.1 ELSE 0 END) > 0 THEN (CASE WHEN y > 0 THEN y * 0.3 ELSE 0 END + CASE WHEN d > 0 THEN d * 0.1 ELSE 0 END) / (CASE WHEN y > 0 THEN 0.3 ELSE 0 END + CASE WHEN d > 0 THEN 0.1 ELSE 0 END) END, 3) AS score FROM ins")
def t8_evidence_score(spark, d):
    return fx.decision_inputs(spark, d).select("asset_id", F.round(decision.evidence_score({"yolo": 0.3, "dino": 0.1}), 3).alias("score"))


@query("t10_state_after", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'FILTERED' ELSE 'REVIEW' END AS status FROM orders")
def t10_state_after(spark, d):
    named = F.when(F.col("o_orderstatus") == "F", "AUTO_PASS").when(F.col("o_orderstatus") == "O", "FILTER")
    return table(spark, d, "orders").select("o_orderkey", decision.state_after(named).alias("status"))


@query("x2_repaired", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN '[1,2]' ELSE '[1]' END AS a FROM events")
def x2_repaired(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.lit('{"a": [1, 2], "b": "cut')).otherwise(F.lit('{"a": [1, 2'))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_json(F.from_json(extracted_of(text), "a array<int>")["a"]).alias("a"))


@query("x7_sign_tags", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['无标识'] WHEN 1 THEN ['限速', '无标识'] ELSE ['无标识'] END AS tags FROM part")
def x7_sign_tags(spark, d):
    raw = F.expr("CASE p_size % 3 WHEN 0 THEN array('unknown') WHEN 1 THEN array('限速', 'unknown', '限速') END")
    return table(spark, d, "part").select("p_partkey", N.sign_tags(raw).alias("tags"))


@query("x8_confidence", "SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN round(event_id / 7, 2) WHEN 1 THEN 0.5 WHEN 2 THEN 0.001 ELSE 0 END::DOUBLE AS confidence, [CASE WHEN event_id % 2 = 0 THEN 'turning' ELSE 'unknown' END] AS ego FROM events")
def x8_confidence(spark, d):
    text = F.expr("CASE event_id % 6 WHEN 0 THEN cast(round(event_id / 7, 2) AS string) WHEN 1 THEN '[0.5, 0.9]' WHEN 2 THEN ' 1e-3' WHEN 3 THEN '0.9abc' WHEN 4 THEN '[]' ELSE 'high' END")
    ego = F.expr("CASE WHEN event_id % 2 = 0 THEN array('flying', 'turning') WHEN event_id % 3 = 0 THEN array('flying') END")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), N.confidence(text).alias("confidence"), N.ego_states(ego, ["turning", "stopped"]).alias("ego"))


@query("x9_checked_events", """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'press' ELSE event_type END AS type, CASE WHEN event_id % 2 = 0 THEN repeat('x', 200) ELSE 'ab' END AS reason,
  CASE WHEN event_id % 3 = 0 THEN repeat('y', 80) ELSE '' END AS anchor FROM events WHERE event_type IN ('click', 'view')""")
def x9_checked_events(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.expr("CASE WHEN event_id % 2 = 0 THEN concat('  ', repeat('x', 300)) ELSE concat(repeat(' ', 250), 'ab', chr(10)) END").alias("reason"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN concat(' ', repeat('y', 90)) END").alias("anchor"),
    )
    known = spark.range(1).selectExpr("explode(array('press', 'view')) AS value")
    alias = spark.range(1).selectExpr("'click' AS alias", "'press' AS value")
    return N.checked_events(events, known, alias).select("id", "type", "reason", "anchor")


@query("x13_evidence_flags", "SELECT p_partkey, p_size % 2 = 0 AS repeat, p_size % 3 = 0 AS generic FROM part")
def x13_evidence_flags(spark, d):
    lamps = F.expr("CASE WHEN p_size % 2 = 0 THEN array('F1: lamp on', 'F2：lamp on') ELSE array('F1:lamp on', 'F12: lamp off') END")
    rest = F.expr("CASE WHEN p_size % 3 = 0 THEN array('F3: moves', ' ', 'F4: waits', 'F5 : goes', 'F6:') ELSE array('F7: stays', NULL) END")
    return table(spark, d, "part").select("p_partkey", N.evidence_flags(F.concat(lamps, rest), "lamp|[0-9]").alias("f")).select("p_partkey", "f.repeat", "f.generic")


REASONS = """CASE p_size % 5 WHEN 0 THEN 'crosses the road' WHEN 1 THEN 'lamp near fence' WHEN 2 THEN 'crosses the road by the lamp' WHEN 3 THEN 'crosses the road from fence to lamp, slowly and with care' ELSE 'moves on' END"""
FLAGGED = f"""concat('F1: ', CASE WHEN p_size % 2 = 0 THEN 'F2: ' ELSE '' END, {REASONS}) AS reason, CASE p_size % 3 WHEN 0 THEN 'red' WHEN 1 THEN '' END AS anchor, CASE WHEN p_size % 4 = 0 THEN 'A' ELSE 'B' END AS type"""


@query("x12_reason_flags", f"""WITH e AS (SELECT p_partkey, {FLAGGED}, CASE p_size % 7 WHEN 0 THEN ['x', 'x'] WHEN 1 THEN ['F3: lamp'] ELSE [] END AS evidence FROM part),
  r AS (SELECT *, trim(concat_ws(' ', reason, nullif(array_to_string(evidence, ' '), ''))) AS raw FROM e),
  t AS (SELECT *, trim(regexp_replace(raw, 'F[0-9]+\\s*[:：]?\\s*', '', 'g')) AS plain FROM r), s AS (SELECT *, concat(coalesce(anchor, ''), ' ', plain) AS seen FROM t)
  SELECT p_partkey, NOT regexp_matches(seen, 'lamp|fence|red|[0-9]') AS generic, contains(seen, 'crosses the road') AND len(list_distinct(regexp_extract_all(seen, 'lamp|fence'))) < 2 AS boiler,
   len(regexp_extract_all(raw, 'F[0-9]+')) < 2 AS weak, type = 'A' AND contains(plain, 'crosses the road') AND 16.0 / length(plain) >= 0.45 AS copies_criteria, len(list_distinct(evidence)) < len(evidence) AS repeat FROM s""")
def x12_reason_flags(spark, d):
    events = table(spark, d, "part").selectExpr("p_partkey", *[x.strip() for x in FLAGGED.replace(" AS reason, ", " AS reason;").replace(" AS anchor, ", " AS anchor;").split(";")], "CASE p_size % 7 WHEN 0 THEN array('x', 'x') WHEN 1 THEN array('F3: lamp') END AS evidence")
    criteria = spark.range(1).selectExpr("'A' AS type", "'crosses the road' AS text")
    return N.reason_flags(events, "lamp|fence|red|[0-9]", "lamp|fence", "crosses the road", criteria).select("p_partkey", "generic", "boiler", "weak", "copies_criteria", "repeat")


@query("x6_old_dimensions", """SELECT event_id AS id, dim, CASE dim WHEN 'road' THEN [CASE event_id % 4 WHEN 0 THEN 'wet' WHEN 3 THEN 'unknown' ELSE 'dry' END] ELSE [CASE WHEN event_id % 2 = 0 THEN 'day' ELSE 'unknown' END] END AS tags
  FROM events, (VALUES ('road'), ('time')) AS v(dim)""")
def x6_old_dimensions(spark, d):
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"road": ["wet"], "surface": "dry", "time": "day"}' WHEN 1 THEN '{"road": [], "surface": "dry", "time": ""}' WHEN 2 THEN '{"road": "", "area": "dry", "time": "day"}' ELSE '{"road": ["lava"], "surface": "dry", "time": 5}' END""")
    docs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.try_parse_json(text).alias("doc"))
    v = spark.range(1).selectExpr("explode(array(struct('road' AS dim, 'wet' AS value), struct('road' AS dim, 'dry' AS value), struct('time' AS dim, 'day' AS value))) AS r").select("r.*")
    none = spark.range(0).selectExpr("'' AS dim", "'' AS alias", "'' AS value")
    return N.checked_values(N.values_long(docs, "id", ["road", "time"], old_names={"road": ["surface", "area"]}), v, none, ["road", "time"])


@query("x7_risk_tags", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['unknown'] ELSE ['high', 'low'] END AS tags FROM part")
def x7_risk_tags(spark, d):
    return table(spark, d, "part").select("p_partkey", N.risk_tags(F.expr("CASE WHEN p_size % 2 = 1 THEN array('high', 'low', 'high') WHEN p_size % 4 = 0 THEN array() END")).alias("tags"))


@query("x10_object_rules", """WITH o AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 3 THEN l_discount END AS confidence, CASE WHEN l_returnflag = 'A' THEN 'moving' END AS state FROM lineitem WHERE l_returnflag <> 'N')
  SELECT id, '小车' AS type, line, state, confidence FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(confidence, 0) DESC, line, l_partkey, l_suppkey) <= 8""")
def x10_object_rules(spark, d):
    objects = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.expr("CASE l_returnflag WHEN 'A' THEN '轿车' WHEN 'R' THEN '小车' ELSE '路标' END").alias("type"), F.expr("CASE WHEN l_returnflag = 'A' THEN 'moving' ELSE 'melting' END").alias("state"),
        F.expr("CASE WHEN l_linenumber <> 3 THEN l_discount END").alias("confidence"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"),
    )
    aliases = spark.range(1).selectExpr("explode(array(struct('轿车' AS alias, '小车' AS value), struct('路标' AS alias, '路牌' AS value))) AS r").select("r.*")
    kept, _ = N.moved_objects(objects, spark.range(1).select(F.lit("小车").alias("value")), aliases=aliases, states=["moving"])
    return kept.select("id", "type", F.col("position.l_linenumber").alias("line"), "state", "confidence")


@query("d8_marked", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['g1'] ELSE ['g2', 'g1'] END AS groups FROM documents")
def d8_marked(spark, d):
    before = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("g1"))).otherwise(F.array(F.lit("g2")))
    return table(spark, d, "documents").select("doc_id", D.marked(before, F.lit("g1")).alias("groups"))


@query("w7_video_clips", "WITH o AS (SELECT user_id, ts, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 30 AS i FROM events) SELECT user_id || '_' || lpad(cast(i AS varchar), 5, '0') AS clip_id, 'v/' || user_id || '.mp4' AS video_id, i::INT AS clip_index, list(event_id ORDER BY ts, event_id) AS frame_ids FROM o GROUP BY user_id, i")
def w7_video_clips(spark, d):
    return seq.build_video_clips(video_frames(spark, d))


def video_frames(spark, d):
    return fx.events_ms(spark, d).select(F.col("event_id").alias("id"), F.concat(F.lit("v/"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("video_path"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1000000D").alias("timestamp"), F.col("event_id").alias("frame_index"))


@query("k7_label_files", f"WITH {fx.BOXES} SELECT CASE WHEN ('0x' || substr(md5(image_id), 1, 8))::BIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(DISTINCT image_id) AS n FROM boxes GROUP BY ALL")
def k7_label_files(spark, d):
    path = shared_path(spark, "labels")
    b = fx.boxes(spark, d)
    line = B.label_line(F.lit(0), B.xyxy_to_centre(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "img_w", "img_h")]))
    per = b.groupBy("image_id").agg(F.collect_list(line).alias("lines")).select(paths.hash_split(F.col("image_id")).alias("split"), F.col("image_id").alias("name"), "lines")
    K.write_labels(per, b.select("cls").distinct(), path)
    return spark.read.parquet(f"{path}/labels").groupBy("split").agg(F.count("*").alias("n"))


@query("k5_package", "SELECT doc_id, substr('asset' || lpad(cast(doc_id AS varchar), 6, '0'), 1, 8) || '_p.jpg' AS target FROM documents")
def k5_package(spark, d):
    from framesift.operators.search import sharded_name

    docs = table(spark, d, "documents")
    return docs.select("doc_id", sharded_name(F.concat(F.lit("asset"), F.lpad(F.col("doc_id").cast("string"), 6, "0")), F.lit("a/b/p.jpg")).alias("target"))


@query("r2_stream_clips", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
 c AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > 86400000 THEN 1 ELSE 0 END AS cut FROM e),
 r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM c),
 w AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run_no ORDER BY ms, event_id) - 1) // 30 AS win FROM r),
 g AS (SELECT user_id, run_no, win, count(*)::INT AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM w GROUP BY ALL)
 SELECT cast(user_id AS varchar) AS run, n, first_ms, last_ms FROM g WHERE n >= 5 AND (run_no, win) <> (SELECT max((run_no, win)) FROM g AS h WHERE h.user_id = g.user_id)""")
def r2_stream_clips(spark, d):
    """Closed clips of a stream of frames; a run's last window is still open when the input ends."""
    return _clip_stream(spark, d, False).select("run", F.size("frame_ids").alias("n"), "first_ms", "last_ms")


def _clip_stream(spark, d, flush):
    """The closed clips, with ``flush`` also those open when the input ends."""
    from framesift.streaming import ingest as R

    folder, checkpoint = shared_path(spark, "frames"), shared_path(spark, "r2")
    fx.events_ms(spark, d).select(F.col("user_id").cast("string").alias("run"), "ms", F.col("event_id").alias("id")).repartition("run").write.parquet(folder)
    frames = spark.readStream.schema("run string, ms long, id long").parquet(folder)
    with R.rocks_state(spark):
        closed = R.run_to_table(R.stream_clips(frames, 86_400_000, 30, 5), "r2_stream_clips", "append", checkpoint)
        return closed.unionByName(write_shared(R.open_clips(spark, checkpoint, 5), "r2-open")) if flush else closed


@query("r2_stream_clips_flushed", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events),
 c AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > 86400000 THEN 1 ELSE 0 END AS cut FROM e),
 r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS run_no FROM c),
 w AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run_no ORDER BY ms, event_id) - 1) // 30 AS win FROM r)
 SELECT cast(user_id AS varchar) AS run, count(*)::INT AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM w GROUP BY user_id, run_no, win HAVING count(*) >= 5""")
def r2_stream_clips_flushed(spark, d):
    """All clips of a bounded stream of frames, the last window of each run included."""
    return _clip_stream(spark, d, True).select("run", F.size("frame_ids").alias("n"), "first_ms", "last_ms")
