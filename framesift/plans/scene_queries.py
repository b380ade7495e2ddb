"""Queries of sequences, searches, tags, decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from framesift.functions import paths
from framesift.operators import aggregates as agg, decision, evaluate, search, sequence as seq, tags as T
from framesift.plans import fixtures as fx
from framesift.plans.registry import query, table

DAY = 86_400_000
RUNS = f"""e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, value FROM events),
 cut AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) > {DAY} THEN 1 ELSE 0 END AS c FROM e),
 runs AS (SELECT user_id, event_id, ms, value, sum(c) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_no FROM cut)"""


@query("w2_split_runs", f"WITH {RUNS} SELECT user_id, event_id, run_no FROM runs")
def w2_split_runs(spark, d):
    return seq.split_runs(fx.events_ms(spark, d), ["user_id"], "ms", ["event_id"], gap_ms=DAY).select("user_id", "event_id", "run_no")


@query("w3_fixed_windows", f"WITH {RUNS} SELECT user_id, run_no, event_id, (row_number() OVER (PARTITION BY user_id, run_no ORDER BY ms, event_id) - 1) // 30 AS window_no FROM runs")
def w3_fixed_windows(spark, d):
    runs = seq.split_runs(fx.events_ms(spark, d), ["user_id"], "ms", ["event_id"], gap_ms=DAY)
    return seq.fixed_windows(runs, ["user_id", "run_no"], ["ms", "event_id"]).select("user_id", "run_no", "event_id", "window_no")


def session_clips(spark, d, events=None, run_rows=seq.RUN_ROWS):
    """Runs of a day's gap, at least five events long, cut every 30 events, with count and bounds."""
    runs = seq.split_runs(fx.events_ms(spark, d) if events is None else events, ["user_id"], "ms", ["event_id"], gap_ms=DAY, run_rows=run_rows)
    sized = seq.with_group(runs, ["user_id", "run_no"], {"n_run": F.count(F.lit(1))}, run_rows).where(F.col("n_run") >= 5)
    cut = seq.fixed_windows(sized, ["user_id", "run_no"], ["ms", "event_id"], run_rows=run_rows)
    return cut.groupBy("user_id", "run_no", "window_no").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.round(F.sum("value"), 2).alias("total"))


@query("w6_session_clips", f"""WITH {RUNS}, sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, run_no) AS n_run FROM runs),
 win AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run_no ORDER BY ms, event_id) - 1) // 30 AS window_no FROM sized WHERE n_run >= 5)
 SELECT user_id, run_no, window_no, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, round(sum(value), 2) AS total FROM win GROUP BY ALL""")
def w6_session_clips(spark, d):
    return session_clips(spark, d)


@query("w1_seq_key", f"""WITH {fx.FRAMES}, n AS (SELECT id, path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS dir FROM frames)
 SELECT id, CASE id % 6 WHEN 0 THEN 'bucket:' || dir WHEN 1 THEN 'v:' || split_part(name, '_', 1) WHEN 2 THEN 'ms:' || dir || ':_' || regexp_extract(name, '_([0-9]).jpg$', 1) WHEN 3 THEN 'secms:' || dir WHEN 4 THEN 'idx:' || dir || ':IMG_' END AS run_id,
  CASE id % 6 WHEN 0 THEN 'seq' WHEN 1 THEN 'seq' WHEN 2 THEN 'ms' WHEN 3 THEN 'ms' WHEN 4 THEN 'idx' END AS mode,
  CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1000 * id WHEN 2 THEN 1700000000000 + 900 * id WHEN 3 THEN (1700000000 + id) * 1000 + rpad(cast(id % 997 AS varchar), 3, '0')::BIGINT WHEN 4 THEN id END AS value FROM n WHERE id % 6 <> 5""")
def w1_seq_key(spark, d):
    return seq.with_seq_key(fx.frames(spark, d)).select("id", "_k.run_id", "_k.mode", "_k.value")


@query("w5_frame_ms", """SELECT event_id AS id, CASE event_id % 6 WHEN 1 THEN 1000 * event_id WHEN 2 THEN 1700000000000 + 900 * event_id
 WHEN 3 THEN (1700000000 + event_id) * 1000 + rpad(cast(event_id % 997 AS varchar), 3, '0')::BIGINT END AS ms FROM events""")
def w5_frame_ms(spark, d):
    return fx.frames(spark, d).select("id", seq.frame_ms(F.col("path")).alias("ms"))


@query("w4_cut_windows", f"""WITH RECURSIVE {RUNS}, o AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS total FROM e),
 w AS (SELECT user_id, event_id, i, total, ms AS t0, 1 AS size, 0 AS win FROM o WHERE i = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.i, o.total, CASE WHEN w.size >= 5 AND o.ms - w.t0 >= {5 * DAY} THEN o.ms ELSE w.t0 END, CASE WHEN w.size >= 5 AND o.ms - w.t0 >= {5 * DAY} THEN 1 ELSE w.size + 1 END,
   CASE WHEN w.size >= 5 AND o.ms - w.t0 >= {5 * DAY} THEN w.win + 1 ELSE w.win END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1),
 sizes AS (SELECT user_id, win, count(*) AS n FROM w GROUP BY ALL), last AS (SELECT user_id, max(win) AS m FROM sizes GROUP BY ALL),
 moved AS (SELECT w.user_id, w.event_id, CASE WHEN w.win = l.m AND s.n < 3 AND l.m > 0 THEN w.win - 1 ELSE w.win END AS win, s.n < 3 AND l.m = 0 AS gone FROM w JOIN last l USING (user_id) JOIN sizes s ON s.user_id = w.user_id AND s.win = w.win)
 SELECT user_id, win::BIGINT AS window_no, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM moved WHERE NOT gone GROUP BY ALL""")
def w4_cut_windows(spark, d):
    events = fx.events_ms(spark, d).select("user_id", "ms", "event_id")
    cut = seq.clip_windows(events, ["user_id"], ["ms", "event_id"], "ms", 5 * DAY / 1000, 5, 3)
    return cut.groupBy("user_id", "window_no").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


#: All events as one run, which no task holds: scanned in blocks.
ONE_RUN = "events AS (SELECT 0 AS user_id, event_id, ts, value FROM main.events)"


def one_run(spark, d):
    return fx.events_ms(spark, d).withColumn("user_id", F.lit(0)).select("user_id", "ms", "event_id", "value")


@query("w2_hot_run", f"WITH {ONE_RUN}, {RUNS.replace(str(DAY), '60000')} SELECT event_id, run_no FROM runs")
def w2_hot_run(spark, d):
    return seq.split_runs(one_run(spark, d), ["user_id"], "ms", ["event_id"], gap_ms=60_000, run_rows=0).select("event_id", "run_no")


@query("w3_hot_run", "SELECT event_id, (row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) - 1) // 30 AS window_no FROM events")
def w3_hot_run(spark, d):
    return seq.fixed_windows(one_run(spark, d), ["user_id"], ["ms", "event_id"], run_rows=0).select("event_id", "window_no")


@query("w4_hot_run", """WITH RECURSIVE o AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
 w AS (SELECT 1::BIGINT AS i, 0 AS no UNION ALL SELECT * FROM (SELECT (SELECT min(n.i) FROM o n, o b WHERE b.i = w.i AND n.i >= w.i + 5 AND n.ms - b.ms >= 43200000) AS i, no + 1 FROM w) WHERE i IS NOT NULL),
 p AS (SELECT o.event_id, w.no, w.i AS head FROM o ASOF JOIN w ON o.i >= w.i), l AS (SELECT max(no) AS last, max(head) AS head, (SELECT count(*) FROM o) - max(head) + 1 AS n FROM p)
 SELECT event_id, (CASE WHEN no = last AND n < 3 THEN no - 1 ELSE no END)::BIGINT AS window_no FROM p, l WHERE NOT (no = last AND n < 3 AND last = 0)""")
def w4_hot_run(spark, d):
    return seq.clip_windows(one_run(spark, d), ["user_id"], ["ms", "event_id"], "ms", DAY / 2000, 5, 3, run_rows=0).select("event_id", "window_no")


@query("w6_hot_run", f"""WITH {ONE_RUN}, {RUNS}, sized AS (SELECT *, count(*) OVER (PARTITION BY user_id, run_no) AS n_run FROM runs),
 win AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run_no ORDER BY ms, event_id) - 1) // 30 AS window_no FROM sized WHERE n_run >= 5)
 SELECT user_id, run_no, window_no, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, round(sum(value), 2) AS total FROM win GROUP BY ALL""")
def w6_hot_run(spark, d):
    return session_clips(spark, d, one_run(spark, d), 0)


KEYED = f"""{fx.FRAMES}, n AS (SELECT id, path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS dir FROM frames WHERE id % 6 <> 5),
 k AS (SELECT id, path, dir, CASE id % 6 WHEN 0 THEN 'bucket:' || dir WHEN 1 THEN 'v:' || split_part(name, '_', 1) WHEN 2 THEN 'ms:' || dir || ':_' || regexp_extract(name, '_([0-9]).jpg$', 1) WHEN 3 THEN 'secms:' || dir ELSE 'idx:' || dir || ':IMG_' END AS run_id,
  CASE WHEN id % 6 < 2 THEN 'seq' WHEN id % 6 < 4 THEN 'ms' ELSE 'idx' END AS mode, CASE WHEN id % 6 < 2 THEN id ELSE 0 END AS sub,
  CASE id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1000 * id WHEN 2 THEN 1700000000000 + 900 * id WHEN 3 THEN (1700000000 + id) * 1000 + rpad(cast(id % 997 AS varchar), 3, '0')::BIGINT ELSE id END AS value FROM n),
 c AS (SELECT *, CASE mode WHEN 'seq' THEN sub <= lag(sub) OVER o WHEN 'ms' THEN value - lag(value) OVER o > 10000 ELSE value - lag(value) OVER o > 2 END AS cut FROM k WINDOW o AS (PARTITION BY run_id, mode ORDER BY value, sub, id)),
 r AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY run_id, mode ORDER BY value, sub, id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS run_no FROM c)"""


@query("w7_seq_clips", f"""WITH {KEYED}, w AS (SELECT *, count(*) OVER p AS total, first(path) OVER o AS head, (row_number() OVER o - 1) // 30 AS win FROM r WINDOW p AS (PARTITION BY run_id, mode, run_no), o AS (PARTITION BY run_id, mode, run_no ORDER BY value, sub, id)),
 g AS (SELECT run_id, mode, run_no, head, dir, win::INT AS clip_index, list(id ORDER BY value, sub, id) AS frame_ids FROM w WHERE total >= 5 GROUP BY ALL),
 i AS (SELECT *, 'seq_' || right(regexp_replace(head, '[^0-9A-Za-z_-]', '_', 'g'), 48) || '_' || lpad(clip_index::VARCHAR, 5, '0') AS legacy_clip_id FROM g)
 SELECT legacy_clip_id || '_' || substr(md5(concat_ws('|', run_id, mode, run_no)), 1, 8) AS clip_id, legacy_clip_id, 'seq:' || dir AS video_id, clip_index, frame_ids FROM i""")
def w7_seq_clips(spark, d):
    return seq.build_seq_clips(fx.frames(spark, d))


@query("w8_clip_seconds", "SELECT DISTINCT source, CASE source WHEN 'src1' THEN 12.0 WHEN 'src2' THEN 15.0 ELSE 10.0 END AS clip_seconds FROM documents")
def w8_clip_seconds(spark, d):
    config = spark.range(1).selectExpr("explode(array(struct('src1' AS scope, 12.0D AS seconds), struct('src2' AS scope, 15.0D AS seconds), struct('*' AS scope, 10.0D AS seconds))) AS c").select("c.*")
    return seq.clip_seconds(table(spark, d, "documents").select("source").distinct(), config, "source")


@query("w9_evenly_spaced", """WITH o AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id)
 SELECT user_id, CASE WHEN len(ids) <= 5 THEN ids ELSE list_transform(list_distinct_ordered, lambda i: ids[i + 1]) END AS picks FROM (SELECT *, list_sort(list_distinct(list_transform(range(0, 5), lambda i: CAST(round_even(i * (len(ids) - 1) / 4, 0) AS BIGINT)))) AS list_distinct_ordered FROM o)""")
def w9_evenly_spaced(spark, d):
    return seq.evenly_spaced_rows(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 5)


@query("w10_first_per_key", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def w10_first_per_key(spark, d):
    return seq.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("w11_capped", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) <= 3")
def w11_capped(spark, d):
    return seq.capped(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("w12_sampled", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) <= 20")
def w12_sampled(spark, d):
    return seq.sampled(table(spark, d, "events"), ["event_type"], "event_id", 20).select("event_type", "event_id")


@query("w13_latest_per_key", "SELECT user_id, event_type, event_id, ts, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w13_latest_per_key(spark, d):
    return seq.latest_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("l6_systematic", "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM p WHERE i % (n // 100) = 0 AND i < (n // 100) * 100")
def l6_systematic(spark, d):
    return seq.systematic(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 100)


@query("l7_hash_split", "SELECT page_id, CASE WHEN ('0x' || substr(md5(url), 1, 8))::BIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM pages")
def l7_hash_split(spark, d):
    return table(spark, d, "pages").select("page_id", paths.hash_split(F.col("url")).alias("split"))


@query("l9_replicated", "SELECT item_id, concat(item_id, '_c', k) AS name FROM benchmark, (SELECT unnest(range(0, 4)) AS k)")
def l9_replicated(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("item_id", F.concat(F.col("item_id").cast("string"), F.lit("_c"), F.col("k").cast("string")).alias("name"))


@query("l10_mini_subset", "SELECT doc_id FROM documents WHERE trim(text) <> '' ORDER BY md5('7:' || doc_id), doc_id LIMIT 300")
def l10_mini_subset(spark, d):
    docs = table(spark, d, "documents").where(F.trim("text") != "")
    return docs.orderBy(F.md5(F.concat_ws(":", F.lit("7"), F.col("doc_id").cast("string"))), "doc_id").limit(300).select("doc_id")


@query("l4_first_by_id", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def l4_first_by_id(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").limit(100).select("doc_id", "source")


@query("l1_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def l1_page(spark, d):
    return search.page(table(spark, d, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 3, 50).select("o_orderkey", "o_orderdate")


@query("l5_capped_folders", "SELECT source AS dir, count(*) AS n FROM documents GROUP BY source ORDER BY source LIMIT 5")
def l5_capped_folders(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("dir")).agg(F.count("*").alias("n")).orderBy("dir").limit(5)


FILTERS = {"lang": ["en", "de"], "quality": ["good"]}


@query("f3_tag_names", f"WITH {fx.ASSETS} SELECT asset_id, CASE WHEN quality IS NULL THEN [] ELSE [qtag] END AS names FROM assets")
def f3_tag_names(spark, d):
    return fx.assets(spark, d).select("asset_id", search.tag_names(F.col("final_tags"), "quality").alias("names"))


@query("f5_search", f"WITH {fx.ASSETS} SELECT id, asset_id, status FROM assets WHERE lang IN ('en', 'de') AND qtag = 'good' ORDER BY id LIMIT 40 OFFSET 40")
def f5_search(spark, d):
    return search.page(search.search(fx.assets(spark, d), FILTERS), ["id"], 2, 40).select("id", "asset_id", "status")


@query("f4_tag_match", f"WITH {fx.ASSETS} SELECT id FROM assets WHERE lang IN ('fr') AND length IN ('long', 'medium')")
def f4_tag_match(spark, d):
    return search.search(fx.assets(spark, d), {"lang": ["fr", " "], "length": ["long", "medium"], "x": []}).select("id")


@query("f6_count", f"WITH {fx.ASSETS} SELECT count(*) AS n FROM assets WHERE lang IN ('en', 'de') AND qtag = 'good' AND status = 'APPROVED'")
def f6_count(spark, d):
    return search.search(fx.assets(spark, d), FILTERS, "APPROVED").agg(F.count("*").alias("n"))


@query("f7_tag_hits", f"WITH {fx.ASSETS} SELECT id, status FROM assets WHERE lang = 'es' ORDER BY id LIMIT 100000")
def f7_tag_hits(spark, d):
    return search.tag_hits(fx.assets(spark, d), {"lang": ["es"]}, ["id", "status"])


@query("f8_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def f8_lookup(spark, d):
    keys = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return search.lookup(table(spark, d, "customer"), keys, ["c_custkey"]).select("c_custkey", "c_name")


@query("f9_listing", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def f9_listing(spark, d):
    return search.listing(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], o_orderstatus="F", o_orderpriority="2-HIGH", o_custkey=None).select("o_orderkey")


@query("f10_review_queue", f"WITH {fx.ASSETS} SELECT id FROM assets WHERE status = 'REVIEW' AND id % 3 = 0 ORDER BY id LIMIT 20")
def f10_review_queue(spark, d):
    rows = fx.assets(spark, d).withColumn("final_result", F.when(F.col("id") % 3 == 0, F.lit('{"risk": "high"}')).otherwise(F.lit("{}"))).withColumn("reason", F.lit("模型检测结果冲突"))
    return search.page(search.review_queue(rows, True, True), ["id"], 1, 20).select("id")


@query("f11_contains_any", "SELECT page_id FROM pages WHERE contains(url, '/en/') OR contains(url, 'blog')")
def f11_contains_any(spark, d):
    return table(spark, d, "pages").where(search.contains_any(F.col("url"), ["/en/", "blog"])).select("page_id")


@query("f12_hour_window", "SELECT event_id FROM events WHERE hour(ts) >= 20 OR hour(ts) < 8")
def f12_hour_window(spark, d):
    return table(spark, d, "events").where(paths.hour_window(F.col("ts"), "20-08")).select("event_id")


@query("f16_judged_class", """SELECT l_orderkey AS seg, CASE WHEN bool_or(l_returnflag = 'R') THEN 'A' WHEN bool_or(l_returnflag = 'A') THEN 'B' END AS cls FROM lineitem GROUP BY l_orderkey""")
def f16_judged_class(spark, d):
    value = F.when(F.col("l_returnflag") == "R", F.lit("限速")).when(F.col("l_returnflag") == "A", F.lit("无标识")).otherwise(F.lit("unknown"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("seg")).agg(F.collect_list(value).alias("v"), F.collect_list("l_linenumber").alias("f"))
    return rows.select("seg", search.judged_class(F.col("v"), F.col("f")).alias("cls"))


@query("f17_resize_plan", """SELECT p_partkey, floor(p_size * 100 * (2000.0 / greatest(p_size * 100, 1500)))::INT AS width, floor(1500 * (2000.0 / greatest(p_size * 100, 1500)))::INT AS height FROM part WHERE greatest(p_size * 100, 1500) > 2000""")
def f17_resize_plan(spark, d):
    plan = search.resize_plan(F.col("p_size") * 100, F.lit(1500), 2000)
    return table(spark, d, "part").select("p_partkey", plan.alias("p")).where("p IS NOT NULL").select("p_partkey", "p.width", "p.height")


@query("f18_undecided", "SELECT o_orderkey AS clip_id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100")
def f18_undecided(spark, d):
    clips = table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("decision"))
    return search.undecided(clips).select("clip_id")


def exported(spark, d):
    a = fx.assets(spark, d)
    rows = a.select("*", F.concat(F.lit("img/"), "project", F.lit("/"), "asset_id", F.lit(".jpg")).alias("image_path"), F.array("project", "lang").alias("directory_chain"), F.col("id").alias("frame_index"), F.lit(0.0).alias("timestamp"), F.create_map(F.lit("vehicle"), F.lit("v1")).alias("business"), F.col("n_chars").cast("int").alias("width"), F.lit(1000).alias("height"), F.lit(0.5).alias("decision_score"))
    return search.export_rows(rows, ["lang", "quality"])


@query("f2_flat_rows", f"""WITH {fx.ASSETS} SELECT asset_id, concat('img/', project, '/', asset_id, '.jpg') AS image_path, concat(project, '/', lang) AS chain,
 CASE WHEN n_chars > 0 THEN CASE WHEN n_chars * 1000 >= 8000000 THEN '8M' WHEN n_chars * 1000 >= 1800000 THEN '2M' ELSE '其他' END ELSE '' END AS resolution, status,
 CASE WHEN quality IS NULL THEN '' ELSE lang END AS lang, coalesce(qtag, '') AS quality FROM assets""")
def f2_flat_rows(spark, d):
    return search.flat_rows(exported(spark, d), ["lang", "quality"])


@query("f1_export_rows", f"""WITH {fx.ASSETS} SELECT asset_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n_final, 1 AS n_ai, status FROM assets""")
def f1_export_rows(spark, d):
    e = exported(spark, d)
    return e.select("asset_id", F.size(F.col("final_tags")["lang"]).alias("n_final"), F.size(F.col("ai_tags")["lang"]).alias("n_ai"), F.col("final.status").alias("status"))


@query("a1_project_stats", f"WITH {fx.ASSETS} SELECT project, count(*) AS raw, count(*) FILTER (status IN ('EMBEDDED', 'REVIEW', 'APPROVED')) AS processed, greatest(0, count(*) - count(*) FILTER (status IN ('EMBEDDED', 'REVIEW', 'APPROVED'))) AS pending FROM assets GROUP BY project")
def a1_project_stats(spark, d):
    a = fx.assets(spark, d)
    return agg.project_stats(a.select("project"), a)


@query("a2_overview", f"WITH {fx.ASSETS} SELECT count(*) AS total, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REVIEW') AS review, format('{{:.1f}}%', 100.0 * count(*) FILTER (status IN ('APPROVED', 'REVIEW')) / count(*)) AS ai_coverage FROM assets")
def a2_overview(spark, d):
    return agg.overview(fx.assets(spark, d))


@query("a3_tag_distribution", f"WITH {fx.ASSETS}, {fx.EFFECTIVE} SELECT dim, tag, count(*) AS n FROM effective WHERE status IN ('APPROVED', 'REVIEW') GROUP BY ALL")
def a3_tag_distribution(spark, d):
    return agg.tag_distribution(fx.assets(spark, d), ["lang", "length", "quality"])


@query("a4_coverage", f"""WITH {fx.ASSETS}, r AS (SELECT 'english' AS name, 500 AS target, count(*) AS current, count(DISTINCT source_id) AS n_sources, coalesce(list_sort(list(DISTINCT source_id)), []) AS sources FROM assets WHERE status = 'APPROVED' AND lang = 'en' UNION ALL
 SELECT 'long_good', 10000, count(*), count(DISTINCT source_id), coalesce(list_sort(list(DISTINCT source_id)), []) FROM assets WHERE status = 'APPROVED' AND length = 'long' AND qtag = 'good')
 SELECT name, target, current, format('{{:.1f}}%', 100.0 * current / target) AS coverage, greatest(0, target - current) AS gap, n_sources, sources FROM r""")
def a4_coverage(spark, d):
    return agg.coverage(fx.assets(spark, d), [{"name": "english", "filters": {"lang": ["en"]}, "target": 500}, {"name": "long_good", "filters": {"length": ["long"], "quality": ["good"]}}])


@query("a5_manifest", f"WITH {fx.ASSETS} SELECT 'status' AS kind, status AS value, count(*) AS n FROM assets GROUP BY ALL UNION ALL SELECT 'quality', qtag, count(*) FROM assets WHERE qtag IS NOT NULL GROUP BY ALL")
def a5_manifest(spark, d):
    m = agg.manifest(fx.assets(spark, d), "quality")
    return m.select(F.lit("status").alias("kind"), F.explode("statuses").alias("value", "n")).union(m.select(F.lit("quality"), F.explode("tags")))


@query("a6_tag_statistics", f"WITH {fx.ASSETS} SELECT dim, count(*) AS total, count(DISTINCT tag) AS n_names, count(*) FILTER (source = 'AI') AS from_ai, count(*) FILTER (source = 'Human') AS from_human, 0::BIGINT AS from_rule FROM (SELECT 'lang' AS dim, lang AS tag, 'AI' AS source FROM assets WHERE quality IS NOT NULL UNION ALL SELECT 'quality', qtag, 'Human' FROM assets WHERE quality IS NOT NULL) GROUP BY dim")
def a6_tag_statistics(spark, d):
    return T.tag_statistics(T.long_tags(fx.assets(spark, d), "final_tags"), ["dim"])


@query("a7_detections_by_engine", "SELECT user_id, count(*) AS engines, max(v) AS top FROM (SELECT user_id, event_type, arg_max(value, (ts, value)) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def a7_detections_by_engine(spark, d):
    cache = table(spark, d, "events").select(F.col("user_id").alias("asset_id"), F.col("event_type").alias("engine"), F.col("value").alias("result"), F.col("ts").alias("updated"))
    m = agg.detections_by_engine(cache)
    return m.select(F.col("asset_id").alias("user_id"), F.size("engines").cast("long").alias("engines"), F.array_max(F.map_values("engines")).alias("top"))


@query("a8_class_counts", "SELECT cls, count(l_orderkey) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS c(cls) LEFT JOIN lineitem ON l_returnflag = cls GROUP BY cls")
def a8_class_counts(spark, d):
    classes = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in "ANRX"])).alias("cls"))
    return agg.class_counts(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cls")), classes)


@query("a9_split_check", "WITH i AS (SELECT page_id, CASE WHEN ('0x' || substr(md5(url), 1, 8))::BIGINT % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM pages) SELECT split, count(*) AS images, count(*) FILTER (page_id % 5 <> 0) AS labels, count(*) = count(*) FILTER (page_id % 5 <> 0) AS equal FROM i GROUP BY split")
def a9_split_check(spark, d):
    images = table(spark, d, "pages").select(F.col("page_id").alias("image_id"), paths.hash_split(F.col("url")).alias("split"))
    return agg.split_check(images, images.where("image_id % 5 <> 0"))


@query("a15_reconcile", f"WITH {fx.ASSETS} SELECT project, count(*) AS in_metadata, count(*) FILTER (id % 11 <> 0) AS in_index, count(*) AS in_catalog, count(*) FILTER (id % 11 <> 0) <> count(*) AS mismatch FROM assets GROUP BY project")
def a15_reconcile(spark, d):
    a = fx.assets(spark, d)
    return agg.reconcile(a.where("id % 11 <> 0"), a, a)


@query("a16_health", "SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS with_video, count(*) FILTER (doc_id % 3 <> 0) AS without_video, 0::BIGINT AS no_path, true AS contiguous FROM documents")
def a16_health(spark, d):
    return agg.health(table(spark, d, "documents").select(F.col("doc_id").alias("vector_id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("video_source"), F.col("lang").alias("path")))


@query("a18_progress", "SELECT o_custkey AS project, count(*) FILTER (o_orderstatus <> 'O') AS done, count(*) AS total FROM orders GROUP BY ALL")
def a18_progress(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count_if(F.col("o_orderstatus") != "O").alias("done"), F.count("*").alias("total"))


@query("a19_distinct", "SELECT DISTINCT source AS project FROM documents")
def a19_distinct(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("project")).distinct()


@query("a20_coarse_counts", "SELECT CASE WHEN p_size < 20 THEN '车辆' ELSE '非机动车' END AS coarse, count(*) AS n FROM part WHERE p_size < 40 GROUP BY ALL")
def a20_coarse_counts(spark, d):
    tag = F.expr("CASE WHEN p_size < 10 THEN '小车' WHEN p_size < 20 THEN '大车' WHEN p_size < 40 THEN '两轮车' ELSE '未知' END")
    return agg.coarse_counts(table(spark, d, "part").select(tag.alias("tag")), {"小车": "车辆", "大车": "车辆", "两轮车": "非机动车"})


DECIDE = """d AS (SELECT *, yl <> dl AS clash, CASE WHEN n = 6 THEN 0 ELSE y END AS y0, CASE WHEN n IN (5, 6) THEN 0 ELSE d END AS d0, CASE WHEN n = 6 THEN 1 ELSE y END AS y1, CASE WHEN n IN (5, 6) THEN 1 ELSE d END AS d1 FROM ins)"""


@query("t7_decide", f"""WITH {fx.DECISIONS}, {DECIDE} SELECT asset_id, rule, decision, CASE WHEN w > 0 THEN round(s / w, 4) END AS score FROM (SELECT asset_id,
 (CASE WHEN y > 0 THEN y * 0.2 ELSE 0 END + CASE WHEN d > 0 THEN d * 0.2 ELSE 0 END) AS s, (CASE WHEN y > 0 THEN 0.2 ELSE 0 END + CASE WHEN d > 0 THEN 0.2 ELSE 0 END) AS w,
 CASE WHEN conflict THEN 'event_detection_conflict' WHEN y0 <= 0 AND d0 <= 0 AND ok THEN 'vlm_only_auto_pass' WHEN y1 < 0.7 OR (y1 IS NOT NULL AND d1 < 0.6) THEN 'low_confidence' WHEN clash THEN 'model_conflict' WHEN y0 >= 0.7 AND d0 >= 0.6 THEN 'auto_pass' ELSE 'default_review' END AS rule,
 CASE WHEN rule IN ('vlm_only_auto_pass', 'auto_pass') THEN 'AUTO_PASS' ELSE 'REVIEW' END AS decision FROM d)""")
def t7_decide(spark, d):
    return decision.decide(fx.decision_inputs(spark, d), decision.preset("balanced")).select("asset_id", "rule", "decision", F.round("score", 4).alias("score"))


@query("t9_preset_strict", f"""WITH {fx.DECISIONS}, {DECIDE} SELECT rule, status, count(*) AS n FROM (SELECT CASE WHEN snow THEN 'business_filter' WHEN conflict THEN 'event_detection_conflict' WHEN y0 <= 0 AND d0 <= 0 AND ok THEN 'vlm_only_auto_pass' WHEN y1 < 0.8 OR (y1 IS NOT NULL AND d1 < 0.7) THEN 'low_confidence' WHEN NOT clash AND y0 >= 0.8 AND d0 >= 0.7 THEN 'auto_pass' ELSE 'default_review' END AS rule,
 CASE WHEN rule = 'business_filter' THEN 'FILTERED' WHEN rule IN ('vlm_only_auto_pass', 'auto_pass') THEN 'APPROVED' ELSE 'REVIEW' END AS status FROM d) GROUP BY ALL""")
def t9_preset_strict(spark, d):
    decided = decision.decide(fx.decision_inputs(spark, d), decision.preset("strict", parity=True))
    return decided.groupBy("rule", decision.state_after(F.col("decision")).alias("status")).agg(F.count("*").alias("n"))


def order_tags(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.lit("flag").alias("dim"), F.col("l_returnflag").alias("tag"), F.when(F.col("l_linestatus") == "O", F.lit("AI")).otherwise(F.lit("Rule")).alias("source"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.col("l_linenumber").alias("position"))
    flag = F.when(F.col("o_orderpriority") < "3", F.lit("R")).otherwise(F.lit("N"))
    human = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("asset_id"), F.lit("flag").alias("dim"), flag.alias("tag"), F.lit("Human").alias("source"), F.lit(1.0).alias("confidence"), F.lit(0).alias("position"))
    return T.merged(lines), human


ORDER_TAGS = """ai AS (SELECT l_orderkey AS asset_id, l_returnflag AS tag, CASE WHEN l_linestatus = 'O' THEN 'AI' ELSE 'Rule' END AS source, max(round(l_discount * 10, 2)) AS confidence, min(l_linenumber) AS position FROM lineitem GROUP BY ALL),
 human AS (SELECT o_orderkey AS asset_id, CASE WHEN o_orderpriority < '3' THEN 'R' ELSE 'N' END AS tag, 'Human' AS source, 1.0 AS confidence FROM orders WHERE o_orderkey % 2 = 0)"""


@query("t1_merged", f"WITH {ORDER_TAGS} SELECT asset_id, tag, source, confidence, position FROM ai")
def t1_merged(spark, d):
    return order_tags(spark, d)[0].select("asset_id", "tag", "source", "confidence", "position")


@query("t4_final_tags", f"WITH {ORDER_TAGS} SELECT asset_id, tag, source, confidence FROM ai WHERE NOT (source = 'AI' AND (asset_id, tag) IN (SELECT (asset_id, tag) FROM human)) UNION ALL SELECT * FROM human")
def t4_final_tags(spark, d):
    return T.final_tags(*order_tags(spark, d)).select("asset_id", "tag", "source", "confidence")


@query("t5_conflicts", f"""WITH {ORDER_TAGS}, a AS (SELECT asset_id, list(DISTINCT tag) AS x FROM ai GROUP BY ALL), h AS (SELECT asset_id, list(DISTINCT tag) AS y FROM human GROUP BY ALL),
 j AS (SELECT asset_id, coalesce(x, []) AS x, coalesce(y, []) AS y FROM a FULL JOIN h USING (asset_id))
 SELECT asset_id, list_sort(list_filter(x, lambda t: NOT list_contains(y, t))) AS only_ai, list_sort(list_filter(y, lambda t: NOT list_contains(x, t))) AS only_human, list_sort(list_intersect(x, y)) AS "both" FROM j WHERE len(list_filter(x, lambda t: NOT list_contains(y, t))) + len(list_filter(y, lambda t: NOT list_contains(x, t))) > 0""")
def t5_conflicts(spark, d):
    return T.conflicts(*order_tags(spark, d)).drop("dim")


def ontology(spark):
    rows = spark.range(1).selectExpr("explode(array(struct('seg' AS dim, 'BUILDING' AS value, 0 AS position), struct('seg' AS dim, 'MACHINERY' AS value, 1 AS position), struct('seg' AS dim, 'unknown' AS value, 2 AS position))) AS r").select("r.*")
    aliases = spark.range(1).selectExpr("explode(array(struct('seg' AS dim, 'AUTOMOBILE' AS alias, 'MACHINERY' AS value))) AS r").select("r.*")
    return rows, aliases


def segment_tags(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("segment")).otherwise(F.lit("seg")).alias("dim"), F.col("c_mktsegment").alias("tag"))


SEG = "s AS (SELECT c_custkey AS asset_id, CASE WHEN c_custkey % 2 = 0 THEN 'segment' ELSE 'seg' END AS dim, c_mktsegment AS tag FROM customer)"


@query("t6_validated", f"WITH {SEG} SELECT asset_id, dim, tag, dim = 'segment' OR tag IN ('BUILDING', 'MACHINERY', 'unknown') AS valid FROM s")
def t6_validated(spark, d):
    return T.validated(segment_tags(spark, d), ontology(spark)[0])


@query("t11_canonical", f"WITH {SEG} SELECT asset_id, 'seg' AS dim, CASE WHEN tag = 'AUTOMOBILE' THEN 'MACHINERY' ELSE tag END AS tag FROM s")
def t11_canonical(spark, d):
    dims = spark.range(1).selectExpr("'segment' AS alias", "'seg' AS dim")
    return T.canonical(segment_tags(spark, d), dims, ontology(spark)[1])


@query("t14_candidates", f"WITH {SEG} SELECT dim, tag, count(*) AS n FROM s WHERE NOT (dim = 'seg' AND tag IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE', 'HOUSEHOLD')) GROUP BY ALL")
def t14_candidates(spark, d):
    dismissed = spark.range(1).selectExpr("'seg' AS dim", "'HOUSEHOLD' AS value")
    values, aliases = ontology(spark)
    return T.candidates(segment_tags(spark, d), values, aliases, dismissed)


@query("t12_value_added", """WITH v AS (SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'), n AS (SELECT value, (row_number() OVER (ORDER BY value) - 1)::INT AS position FROM v), k AS (SELECT count(*)::INT AS k FROM n)
  SELECT 'seg' AS dim, value, position FROM n UNION ALL SELECT 'seg', 'AUTOMOBILE', k FROM k UNION ALL SELECT 'seg', 'unknown', k + 1 FROM k""")
def t12_value_added(spark, d):
    values = table(spark, d, "customer").where("c_mktsegment <> 'AUTOMOBILE'").select(F.col("c_mktsegment").alias("value")).distinct()
    rest = values.select(F.lit("seg").alias("dim"), "value", (F.row_number().over(W.orderBy("value")) - 1).alias("position"))
    last = values.agg(F.lit("seg").alias("dim"), F.lit("unknown").alias("value"), F.count("*").cast("int").alias("position"))
    return T.value_added(rest.union(last), ontology(spark)[1], "seg", "AUTOMOBILE")[0]


@query("t13_mapped_labels", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['行人', '小车'] WHEN p_size % 3 = 1 THEN ['小车'] ELSE [] END AS objects FROM part")
def t13_mapped_labels(spark, d):
    raw = F.expr("CASE WHEN p_size % 3 = 0 THEN array(' Person', 'car', 'CAR ', 'cat') WHEN p_size % 3 = 1 THEN array('car', 'dog') ELSE array('cat') END")
    return table(spark, d, "part").select("p_partkey", T.mapped_labels(raw, {"person": "行人", "car": "小车", "truck": "大车"}).alias("objects"))


@query("j20_unsupported_events", """WITH o AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY ALL)
 SELECT o_orderkey AS asset_id, o_orderstatus AS event, CASE o_orderstatus WHEN 'O' THEN NOT coalesce(r, false) WHEN 'F' THEN NOT (coalesce(r, false) OR coalesce(a, false)) ELSE false END AS unsupported FROM orders LEFT JOIN o ON id = o_orderkey""")
def j20_unsupported_events(spark, d):
    needs = spark.range(1).selectExpr("explode(array(struct('O' AS event, 'R' AS object), struct('F' AS event, 'R' AS object), struct('F' AS event, 'A' AS object))) AS r").select("r.*")
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderstatus").alias("event"))
    return T.unsupported_events(events, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_returnflag").alias("object")), needs)


@query("m15_complemented", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END AS tags FROM part")
def m15_complemented(spark, d):
    model = F.array(F.lit("b"), F.lit("c"), F.lit("d"))
    rejected = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("c"), F.lit("d"))).otherwise(F.array(F.lit("d")))
    return table(spark, d, "part").select("p_partkey", T.complemented(F.array(F.lit("a"), F.lit("b")), model, rejected).alias("tags"))


DIMS = ["quality", "toxic", "risk"]


@query("e1_asset_dim_metrics", f"WITH {fx.METRICS} SELECT model, asset_id, dim, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM metrics")
def e1_asset_dim_metrics(spark, d):
    return evaluate.asset_dim_metrics(*fx.predictions(spark, d), DIMS)


POOLED = """pooled AS (SELECT model, asset_id, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, CASE WHEN sum(tp + fp) > 0 THEN round(sum(tp) / sum(tp + fp), 4) ELSE 0 END AS precision, CASE WHEN sum(tp + fn) > 0 THEN round(sum(tp) / sum(tp + fn), 4) ELSE 0 END AS recall,
 CASE WHEN sum(tp) > 0 THEN round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) ELSE 0 END AS f1 FROM metrics GROUP BY ALL)"""


@query("e2_pooled", f"WITH {fx.METRICS}, {POOLED} SELECT * FROM pooled")
def e2_pooled(spark, d):
    return evaluate.pooled(evaluate.asset_dim_metrics(*fx.predictions(spark, d), DIMS))


@query("e5_summary", f"WITH {fx.METRICS}, {POOLED} SELECT model, count(*) AS n, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM pooled GROUP BY model")
def e5_summary(spark, d):
    return evaluate.summary(evaluate.pooled(evaluate.asset_dim_metrics(*fx.predictions(spark, d), DIMS)))


@query("e4_dim_summary", f"WITH {fx.METRICS} SELECT model, dim, round(avg(round(precision, 4)), 4) AS precision, round(avg(round(recall, 4)), 4) AS recall, round(avg(round(f1, 4)), 4) AS f1 FROM metrics GROUP BY ALL")
def e4_dim_summary(spark, d):
    return evaluate.dim_summary(evaluate.asset_dim_metrics(*fx.predictions(spark, d), DIMS))


@query("e3_fused", f"WITH {fx.PREDICTIONS} SELECT DISTINCT 'fusion' AS model, asset_id, dim, tag FROM predicted WHERE model IN ('size', 'lang')")
def e3_fused(spark, d):
    p = fx.predictions(spark, d)[1]
    return evaluate.fused(p.where("model = 'size'"), p.where("model = 'lang'"))


@query("e6_merged_names", f"WITH {fx.PREDICTIONS} SELECT asset_id, dim, list_sort(list(DISTINCT tag)) AS tags FROM predicted GROUP BY ALL")
def e6_merged_names(spark, d):
    return evaluate.merged_names(fx.predictions(spark, d)[1])


def detector_scores(spark, d):
    lines = table(spark, d, "lineitem")
    base = lines.select(F.col("l_orderkey").alias("segment"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("frame"), F.col("l_returnflag").alias("cls"), F.col("l_linestatus").alias("grp"), "l_discount", "l_tax")
    old = base.select("segment", "frame", "cls", "grp", F.lit("old").alias("model"), F.round(F.col("l_discount") * 3.5, 4).alias("score"))
    new = base.select("segment", "frame", "cls", "grp", F.lit("new").alias("model"), F.round(F.col("l_tax") * 5, 4).alias("score"))
    return old, new


SCORES = """base AS (SELECT l_orderkey AS segment, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS frame, l_returnflag AS cls, l_linestatus AS grp, round(l_discount * 3.5, 4) AS o, round(l_tax * 5, 4) AS n FROM lineitem),
 bothm AS (SELECT segment, frame, cls, grp, 'old' AS model, o AS score FROM base UNION ALL SELECT segment, frame, cls, grp, 'new', n FROM base)"""


@query("e7_hit_rates", f"""WITH {SCORES}, s AS (SELECT model, grp, segment, max(score) AS score, count(*) AS f, count(*) FILTER (score >= 0.25) AS fh, count(*) FILTER (score >= 0.15 AND score < 0.25) AS fw FROM bothm GROUP BY ALL)
 SELECT model, grp, sum(f)::BIGINT AS n_frames, count(*) AS n_segments, sum(fh)::BIGINT AS frames_high, sum(fw)::BIGINT AS frames_low, count(*) FILTER (score >= 0.25) AS segments_high, count(*) FILTER (score >= 0.15 AND score < 0.25) AS segments_low, round(sum(fh) / sum(f), 4) AS frame_rate, round(count(*) FILTER (score >= 0.25) / count(*), 4) AS segment_rate FROM s GROUP BY ALL""")
def e7_hit_rates(spark, d):
    old, new = detector_scores(spark, d)
    return evaluate.hit_rates(old.union(new))


@query("e8_quadrants", f"""WITH {SCORES}, q AS (SELECT frame, max(o) >= 0.25 AS o, max(n) >= 0.25 AS n FROM base GROUP BY frame) SELECT CASE WHEN o AND n THEN 'both' WHEN o THEN 'old_only' WHEN n THEN 'new_only' ELSE 'none' END AS quadrant, count(*) AS n FROM q GROUP BY ALL""")
def e8_quadrants(spark, d):
    old, new = detector_scores(spark, d)
    return evaluate.quadrants(old, new, ["frame"]).groupBy("quadrant").agg(F.count("*").alias("n"))


@query("e9_class_quadrants", f"""WITH {SCORES}, q AS (SELECT cls, frame, max(o) >= 0.25 AS o, max(n) >= 0.25 AS n FROM base GROUP BY ALL), t AS (SELECT count(DISTINCT frame) AS n_frames FROM base),
 c AS (SELECT cls, count(*) FILTER (o AND n) AS "both", count(*) FILTER (o AND NOT n) AS old_only, count(*) FILTER (n AND NOT o) AS new_only FROM q GROUP BY cls)
 SELECT cls, "both", old_only, new_only, n_frames - "both" - old_only - new_only AS none, CASE WHEN new_only > old_only THEN 'up' WHEN new_only < old_only THEN 'down' ELSE 'same' END AS direction FROM c, t""")
def e9_class_quadrants(spark, d):
    old, new = detector_scores(spark, d)
    classes = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in "ANR"])).alias("cls"))
    return evaluate.class_quadrants(classes, old.select("frame").distinct(), old, new)


@query("e10_segment_values", f"""WITH {SCORES} SELECT segment, model, coalesce(nullif(string_agg(DISTINCT CASE cls WHEN 'A' THEN '限速' ELSE cls END, '、' ORDER BY CASE cls WHEN 'A' THEN '限速' ELSE cls END), ''), '无标识') AS value FROM bothm WHERE score >= 0.25 GROUP BY ALL""")
def e10_segment_values(spark, d):
    old, new = detector_scores(spark, d)
    return evaluate.segment_values(old.union(new).where("score >= 0.25"), {"A": "限速"})


@query("e11_deploy_check", "SELECT l_linestatus AS weight, l_returnflag AS cls, count(*) AS n, max(l_discount) AS max_conf FROM lineitem GROUP BY ALL")
def e11_deploy_check(spark, d):
    return evaluate.deploy_check(table(spark, d, "lineitem").select(F.col("l_linestatus").alias("weight"), F.col("l_returnflag").alias("cls"), F.col("l_discount").alias("conf")))


@query("a14_epoch_matrix", "SELECT o_orderstatus AS cls, max(m) FILTER (y = 1) AS \"1\", max(m) FILTER (y = 2) AS \"2\", max(m) FILTER (y = 3) AS \"3\" FROM (SELECT o_orderstatus, month(o_orderdate) AS y, count(*) AS m FROM orders GROUP BY ALL) GROUP BY ALL")
def a14_epoch_matrix(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("cls"), F.month("o_orderdate").alias("epoch")).agg(F.count("*").alias("m"))
    return evaluate.epoch_matrix(m, "m", [1, 2, 3])
