"""Queries of labels, cases, categories and file formats over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import aggregates as agg, boxes as B, catalog, evaluate, search, tags
from framesift.plans import fixtures as fx
from framesift.plans.registry import query, table
from framesift.plans.shared import shared_path
from framesift.plans.scene_queries import SCORES, detector_scores
from framesift.sources import readers as S, writers as K
from framesift.streaming import ingest as R

PREDICTED = "CASE WHEN n_chars > 800 THEN 'good' ELSE 'bad' END"


@query("e13_hard_cases", f"""WITH {fx.ASSETS} SELECT asset_id, substr(sha256(asset_id), 1, 16) AS case_id, {PREDICTED} AS only_ai, qtag AS only_human, 'NEW' AS status FROM assets WHERE quality IS NOT NULL AND qtag <> {PREDICTED}""")
def e13_hard_cases(spark, d):
    a = fx.assets(spark, d).where("quality IS NOT NULL").withColumn("dim", F.lit("quality"))
    diffs = tags.conflicts(a.selectExpr("asset_id", "dim", f"{PREDICTED} AS tag"), a.selectExpr("asset_id", "dim", "qtag AS tag"))
    cases = evaluate.hard_cases(diffs)
    return cases.select("asset_id", "case_id", F.col("diff.quality.only_ai")[0].alias("only_ai"), F.col("diff.quality.only_human")[0].alias("only_human"), "status")


@query("e13_benchmark_split", "SELECT doc_id FROM documents WHERE source = 'src0' AND doc_id % 5 = 0")
def e13_benchmark_split(spark, d):
    samples = table(spark, d, "documents").selectExpr("doc_id", "source AS project", "CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split")
    return evaluate.benchmark_samples(samples, "src0", "val").select("doc_id")


@query("e13_listed_cases", "SELECT o_orderkey AS case_id, rank FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)::INT AS rank FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') WHERE rank <= 50")
def e13_listed_cases(spark, d):
    cases = table(spark, d, "orders").selectExpr("o_orderkey AS case_id", "o_orderpriority AS project", "o_orderstatus AS status", "o_orderdate AS created_at")
    first = evaluate.listed_cases(cases, "1-URGENT", "F").limit(50).select("case_id", "created_at")
    from pyspark.sql import Window as W

    return first.select("case_id", F.row_number().over(W.orderBy(F.desc("created_at"), "case_id")).alias("rank"))


@query("b15_folded_frames", """WITH l AS (SELECT l_orderkey, count(*) AS n, list_sort(list(concat(l_linenumber, ' ', l_quantity::INT, ' ', l_partkey, ' ', l_suppkey))) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
  SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, concat('own_', o_orderkey) AS name, coalesce(lines, []) AS lines, coalesce(n, 0)::INT AS n_boxes FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def b15_folded_frames(spark, d):
    return folded(spark, d)


def folded(spark, d):
    frames = table(spark, d, "orders").selectExpr("CASE WHEN o_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split", "cast(o_orderkey AS string) AS stem")
    line = F.concat_ws(" ", "l_linenumber", F.col("l_quantity").cast("int"), "l_partkey", "l_suppkey")
    labels = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("stem"), F.when(F.col("l_returnflag") == "R", line).otherwise(F.lit(" ")).alias("line"))
    return B.folded_frames(frames, labels, "own_")


@query("b15_class_counts", "SELECT cast(l_linenumber AS varchar) AS cls, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY ALL")
def b15_class_counts(spark, d):
    return B.line_class_counts(folded(spark, d))


@query("b12_silent_names", "SELECT concat(l_returnflag, l_linestatus) AS name, count(*) AS n FROM lineitem WHERE concat(l_returnflag, l_linestatus) NOT IN ('AF', 'NO') GROUP BY ALL")
def b12_silent_names(spark, d):
    names = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"))
    return agg.unmapped(names, F.when(F.col("name") == "AF", F.lit("mapped")), ["NO"])


@query("t2_machine_tags", """SELECT p_partkey, dim, position, tag, source, confidence, model FROM (
  SELECT p_partkey, 'size' AS dim, 0 AS position, 'big' AS tag, 'AI' AS source, 1.0::DOUBLE AS confidence, 'unknown' AS model FROM part UNION ALL SELECT p_partkey, 'size', 1, 's' || p_size, 'AI', 0.25, 'm1' FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'kind', 0, 'k', 'Human', 1.0, 'unknown' FROM part WHERE p_size % 3 = 0)""")
def t2_machine_tags(spark, d):
    text = F.expr("""concat('{"size": ["big", ', CASE WHEN p_size % 2 = 0 THEN concat('{"tag": "s', p_size, '", "confidence": 0.25, "model": "m1"}') ELSE '7' END, ', null, {"x": 1}]', CASE WHEN p_size % 3 = 0 THEN ', "kind": [{"tag": "k", "source": "Human"}]' ELSE ', "kind": "bare"' END, '}')""")
    docs = table(spark, d, "part").select("p_partkey", F.try_parse_json(text).alias("doc"))
    return tags.machine_tags(docs, ["size", "kind"], key="p_partkey")


@query("t15_tag_helpers", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['b', 'b'] ELSE ['a', 'b', 'b'] END AS kept, CASE WHEN p_size % 2 = 0 THEN ['b'] ELSE ['a', 'b'] END AS of_ai, ['a', 'b'] AS less FROM part")
def t15_tag_helpers(spark, d):
    each = F.expr("array(named_struct('tag', 'a', 'source', CASE WHEN p_size % 2 = 0 THEN 'Human' ELSE 'AI' END), named_struct('tag', 'b', 'source', 'AI'), named_struct('tag', 'b', 'source', 'Human'))")
    rows = table(spark, d, "part").select("p_partkey", each.alias("t"))
    t = F.col("t")
    return rows.select("p_partkey", tags.without_tag(t, "a", "Human")["tag"].alias("kept"), tags.tags_by_source(t, "AI")["tag"].alias("of_ai"), tags.without_tag(t, "b", "Human")["tag"].alias("less"))


@query("t16_scene_categories", "SELECT r_name AS category, list_sort(list(n_name)) AS details, 'own' AS focus FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT 'old', ['x'], 'legacy' FROM region WHERE r_regionkey = 0")
def t16_scene_categories(spark, d):
    named = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("details"))
    own = named.select(F.array(F.struct(F.col("r_name").alias("category"), "details", F.lit("own").alias("focus"))).alias("scene_categories"))
    old = table(spark, d, "region").where("r_regionkey = 0").selectExpr("array(named_struct('category', 'old', 'details', array('x'), 'focus', 'legacy')) AS scene_categories")
    return tags.scene_categories(own, old).union(tags.scene_categories(own.limit(0), old))


@query("s1_media_files", "SELECT DISTINCT concat('l_returnflag=', l_returnflag) AS dir, true AS has_size FROM lineitem")
def s1_media_files(spark, d):
    path = shared_path(spark, "media")
    flags = table(spark, d, "lineitem").select("l_returnflag", F.lit(1).alias("x")).distinct()
    flags.write.partitionBy("l_returnflag").parquet(path)
    flags.write.partitionBy("l_returnflag").mode("append").json(path)
    found = S.media_files(spark, path, [".parquet"])
    return found.select(F.element_at(F.split("dir", "/"), -1).alias("dir"), (F.col("length") > 0).alias("has_size")).distinct()


@query("s10_truth_csv", """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS image_id, l_returnflag AS cls, l_partkey::DOUBLE AS x0, l_suppkey::DOUBLE AS y0, CASE WHEN l_linenumber <> 2 THEN l_partkey + l_quantity END::DOUBLE AS x1,
  (l_suppkey + l_linenumber)::DOUBLE AS y1, l_linenumber = 2 AS bad FROM lineitem""")
def s10_truth_csv(spark, d):
    path = shared_path(spark, "truth")
    rows = table(spark, d, "lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS filename", "l_partkey AS x_from", "l_suppkey AS y_from", "CASE WHEN l_linenumber = 2 THEN 'wide' ELSE cast(l_quantity AS string) END AS width", "l_linenumber AS height", "l_returnflag AS sign_class")
    rows.write.option("header", "true").csv(path)
    return S.truth_csv(spark, path)


@query("k1_json_lines", f"WITH {fx.ASSETS} SELECT asset_id, source_id, id AS frame_index FROM assets")
def k1_json_lines(spark, d):
    path = shared_path(spark, "export")
    K.write_export(exported(spark, d), path, "jsonl", ["lang"])
    return spark.read.json(path).select("asset_id", "source.source_id", "frame.frame_index")


@query("k3_csv_round_trip", f"WITH {fx.ASSETS} SELECT asset_id, status, true AS marked FROM assets")
def k3_csv_round_trip(spark, d):
    path = shared_path(spark, "export")
    K.write_export(exported(spark, d), path, "csv", ["lang"])
    first = spark.read.text(path, wholetext=True).select(F.min(F.startswith("value", F.lit(K.BYTE_ORDER_MARK))).alias("marked"))
    rows = spark.read.option("header", "true").csv(path)
    named = rows.toDF(*[c.lstrip(K.BYTE_ORDER_MARK) for c in rows.columns])
    return named.select("asset_id", "status").crossJoin(F.broadcast(first))


@query("k5_package_files", f"WITH {fx.ASSETS} SELECT asset_id, 'img/' || asset_id AS image_path, substr(asset_id, 1, 8) || '_' || asset_id AS target, status, source_id FROM assets")
def k5_package_files(spark, d):
    """A package read back: its copy list and its metadata by asset."""
    path = shared_path(spark, "package")
    K.write_export(exported(spark, d), path, "package", ["lang"])
    metadata = spark.read.json(f"{path}/metadata").select("asset_id", "final.status", "source.source_id")
    return spark.read.parquet(f"{path}/files").join(metadata, "asset_id")


@query("k10_layout", "SELECT concat('project=', source, '/processed') AS folder, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY ALL")
def k10_layout(spark, d):
    root = shared_path(spark, "projects")
    for name in ("src1", "src2"):
        table(spark, d, "documents").where(F.col("source") == name).select("doc_id").write.parquet(K.project_path(root, name, "processed"))
    rows = spark.read.parquet(f"{root}/project=*/processed").select(F.regexp_extract(F.col("_metadata.file_path"), "(project=[^/]*/[^/]*)/", 1).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"))


@query("k11_latest_snapshot", "SELECT doc_id AS id, '2024-02-01' AS ts FROM documents WHERE source = 'src1' AND doc_id % 3 = 0")
def k11_latest_snapshot(spark, d):
    path = shared_path(spark, "snapshots")
    docs = table(spark, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("id"))
    K.write_snapshot(docs, path, "2024-01-01")
    K.write_snapshot(docs.where("id % 3 = 0"), path, "2024-02-01")
    return S.latest_snapshot(spark, path, "src1")


@query("m19_clear_counts", """WITH c AS (SELECT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
  SELECT count(*) AS had, count(*) FILTER (c_mktsegment <> 'BUILDING') AS cleared, count(*) FILTER (c_mktsegment = 'BUILDING') AS kept FROM c""")
def m19_clear_counts(spark, d):
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    clips = table(spark, d, "orders").selectExpr("o_custkey", "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS result", "CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS score")
    return catalog.clear_counts(clips, keep, "o_custkey", ["result", "score"])


@query("m26_first_run", "SELECT concat(source, '/', doc_id) AS path, concat('root/', source) AS dir, 'seed' AS outcome FROM documents WHERE doc_id % 3 <> 0")
def m26_first_run(spark, d):
    files = table(spark, d, "documents").selectExpr("concat(source, '/', doc_id) AS path", "concat('root/', source) AS dir", "doc_id")
    jobs = spark.range(0).selectExpr("'' AS dir", "0 AS step")
    return R.discovery_round(files.select("path", "dir"), files.where("doc_id % 3 = 0"), jobs, 10, 6, True)


@query("a13_class_hits", f"""WITH {SCORES}, f AS (SELECT cls, segment, frame, max((model = 'old' AND score >= 0.25)::INT) AS o, max((model = 'new' AND score >= 0.25)::INT) AS n FROM bothm GROUP BY ALL),
  s AS (SELECT cls, segment, sum(o) AS fo, sum(n) AS fn, max(o) AS so, max(n) AS sn FROM f GROUP BY ALL), t AS (SELECT count(DISTINCT segment) AS k FROM bothm)
  SELECT cls, sum(fo)::BIGINT AS frames_old, sum(fn)::BIGINT AS frames_new, sum(so)::BIGINT AS segments_old, sum(sn)::BIGINT AS segments_new, round(sum(so) / any_value(k), 4) AS segment_rate_old, round(sum(sn) / any_value(k), 4) AS segment_rate_new
  FROM s, t GROUP BY cls HAVING sum(fo) > 0 OR sum(fn) > 0""")
def a13_class_hits(spark, d):
    return evaluate.class_hits(*detector_scores(spark, d))


@query("b3_corner_boxes", "SELECT p_partkey, round(p_size / 100 + p_partkey % 7 / 20, 6) AS cx, round(p_partkey % 5 / 10 + p_size % 3 / 20, 6) AS cy, round(p_partkey % 7 / 10, 6) AS w, round(p_size % 3 / 10, 6) AS h FROM part")
def b3_corner_boxes(spark, d):
    box = B.xywh_to_centre(F.col("p_size") / 100, F.col("p_partkey") % 5 / 10, F.col("p_partkey") % 7 / 10, F.col("p_size") % 3 / 10)
    return table(spark, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", *[F.round(F.col("b")[c], 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("s13_quoted_names", "SELECT p_partkey, id, name FROM (SELECT p_partkey, 0 AS id, p_brand AS name FROM part UNION ALL SELECT p_partkey, p_size, 'x y' FROM part WHERE p_size % 2 = 0)")
def s13_quoted_names(spark, d):
    text = F.expr("concat('names: {0: \\'', p_brand, '\\'', CASE WHEN p_size % 2 = 0 THEN concat(', ', p_size, ' : \\'x y\\'') ELSE '' END, '}')")
    return table(spark, d, "part").select("p_partkey", F.inline(S.quoted_class_names(text)))


@query("l2_newest", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def l2_newest(spark, d):
    return search.listing(table(spark, d, "orders"), [F.desc("o_orderdate"), "o_orderkey"], o_orderstatus="F").limit(100).select("o_orderkey", "o_orderdate")


def exported(spark, d):
    a = fx.assets(spark, d)
    return a.select(
        "*", F.concat(F.lit("img/"), "asset_id").alias("image_path"), F.array("project").alias("directory_chain"), F.col("id").alias("frame_index"), F.lit(0.0).alias("timestamp"), F.create_map(F.lit("vehicle"), F.lit("v1")).alias("business"),
        F.col("n_chars").cast("int").alias("width"), F.lit(1).alias("height"), F.lit(0.5).alias("decision_score"),
    )
