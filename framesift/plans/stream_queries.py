"""Streams over the given tables, arriving out of order in several micro-batches, with the SQL of the whole input."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.plans import fixtures as fx
from framesift.plans.registry import query, table
from framesift.plans.scene_queries import DAY, RUNS
from framesift.plans.shared import shared_path
from framesift.streaming import ingest as R, timed as Z, watch as D

HALF_DAYS = RUNS.replace(f"> {DAY}", f"> {DAY // 2}")
DELAY = "30 hours"


def late_events(spark, d, columns, schema):
    """Events up to a day late, in four micro-batches."""
    folder = shared_path(spark, "arrivals")
    fx.arrivals(fx.events_ms(spark, d).select(*columns), "ms", 4, DAY, folder)
    return fx.arriving(spark, schema, "ms", folder)


@query("r2_timed_clips", f"""WITH RECURSIVE {HALF_DAYS}, o AS (SELECT user_id, run_no, event_id, ms, row_number() OVER (PARTITION BY user_id, run_no ORDER BY ms, event_id) AS i, count(*) OVER p AS total, min(ms) OVER p <> max(ms) OVER p AS timed FROM runs WINDOW p AS (PARTITION BY user_id, run_no)),
 w AS (SELECT user_id, run_no, event_id, i, total, ms, ms AS t0, 1 AS size, 0 AS win FROM o WHERE i = 1 AND timed UNION ALL
  SELECT o.user_id, o.run_no, o.event_id, o.i, o.total, o.ms, CASE WHEN w.size >= 5 AND o.ms - w.t0 >= {DAY // 4} THEN o.ms ELSE w.t0 END, CASE WHEN w.size >= 5 AND o.ms - w.t0 >= {DAY // 4} THEN 1 ELSE w.size + 1 END,
   CASE WHEN w.size >= 5 AND o.ms - w.t0 >= {DAY // 4} THEN w.win + 1 ELSE w.win END FROM w JOIN o ON o.user_id = w.user_id AND o.run_no = w.run_no AND o.i = w.i + 1),
 sizes AS (SELECT user_id, run_no, win, count(*) AS n FROM w GROUP BY ALL), last AS (SELECT user_id, run_no, max(win) AS m FROM sizes GROUP BY ALL),
 moved AS (SELECT w.user_id, w.run_no, w.event_id, w.ms, w.i, CASE WHEN w.win = l.m AND s.n < 3 AND l.m > 0 THEN w.win - 1 ELSE w.win END AS win, s.n < 3 AND l.m = 0 AS gone FROM w JOIN last l USING (user_id, run_no) JOIN sizes s ON s.user_id = w.user_id AND s.run_no = w.run_no AND s.win = w.win),
 every AS (SELECT user_id, run_no, event_id, ms, i, win::BIGINT AS win FROM moved WHERE NOT gone UNION ALL SELECT user_id, run_no, event_id, ms, i, (i - 1) // 5 FROM o WHERE NOT timed)
 SELECT user_id::VARCHAR AS run, run_no, win AS window_no, list(event_id ORDER BY i) AS frame_ids, min(ms) AS first_ms, max(ms) AS last_ms FROM every GROUP BY user_id, run_no, win""")
def r2_timed_clips(spark, d):
    frames = late_events(spark, d, [F.col("user_id").cast("string").alias("run"), "ms", F.col("event_id").alias("id")], "run string, ms long, id long")
    with R.rocks_state(spark):
        return R.run_to_table(Z.stream_timed_clips(frames, DAY // 2, DAY / 4000, 5, 3, DELAY), "r2_timed_clips", "append", shared_path(spark, "r2")).where("run IS NOT NULL")


SESSIONS = f"WITH {HALF_DAYS} SELECT user_id, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM runs GROUP BY user_id, run_no"


@query("w2_session_runs", SESSIONS)
def w2_session_runs(spark, d):
    return Z.session_runs(fx.events_ms(spark, d).select("user_id", F.timestamp_millis("ms").alias("ts")), "user_id", "ts", DAY // 2)


@query("r2_session_runs", SESSIONS)
def r2_session_runs(spark, d):
    events = late_events(spark, d, ["user_id", "ms", "event_id"], "user_id long, ms long, event_id long")
    return R.run_to_table(Z.session_runs(events, "user_id", "ts", DAY // 2, DELAY), "r2_session_runs", "append", shared_path(spark, "r2s")).where("user_id IS NOT NULL")


@query("r4_error_counts", """WITH o AS (SELECT user_id::VARCHAR AS clip_id, epoch_us(ts) // 1000 AS told, event_type || (event_id % 3) AS message, value < 2 AS valid FROM events WHERE value < 2 OR value > 120)
 SELECT clip_id, count(*) FILTER (NOT valid) AS n_errors, arg_max(message, (told, message)) FILTER (NOT valid) AS last_error, bool_or(valid) AS valid, CASE WHEN count(*) FILTER (NOT valid) >= 3 AND NOT bool_or(valid) THEN 'REVIEW' END AS decision FROM o GROUP BY clip_id""")
def r4_error_counts(spark, d):
    folder = shared_path(spark, "outcomes")
    rows = fx.events_ms(spark, d).where("value < 2 OR value > 120")
    rows.selectExpr("cast(user_id AS string) AS clip_id", "ms AS at", "concat(event_type, event_id % 3) AS message", "value < 2 AS valid").repartition(4).write.parquet(folder)
    stream = spark.readStream.schema("clip_id string, at long, message string, valid boolean").option("maxFilesPerTrigger", 2).parquet(folder).withColumn("ts", F.timestamp_millis("at"))
    with R.rocks_state(spark):
        told = R.run_to_table(Z.stream_error_counts(stream, "60 days"), "r4_error_counts", "update", shared_path(spark, "r4"))
    last = told.groupBy("clip_id").agg(F.max_by(F.struct("n_errors", "last_error", "valid", "decision"), "version").alias("s"))
    return last.select("clip_id", "s.*")


@query("r5_redelivered", "SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events")
def r5_redelivered(spark, d):
    """Every third event is delivered twice, in other micro-batches; what has passed the watermark is forgotten, and too late to come again."""
    folder = shared_path(spark, "deliveries")
    events = fx.events_ms(spark, d).select("event_id", "user_id", "ms")
    twice = events.withColumn("copy", F.lit(0)).unionByName(events.where("event_id % 3 = 0").withColumn("copy", F.lit(1)))
    fx.arrivals(twice, "ms", 4, DAY, folder)
    stream = fx.arriving(spark, "event_id long, user_id long, ms long, copy int", "ms", folder)
    once = R.once_each(stream.select("event_id", "user_id", "ms", "ts"), ["event_id"], ("ts", DELAY))
    return R.run_to_table(once, "r5_redelivered", "append", shared_path(spark, "r5w")).where("event_id IS NOT NULL").select("event_id", "user_id", "ms")


@query("r1_discovery_stream", """WITH dirs AS (SELECT source, row_number() OVER (ORDER BY source) AS rank FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 3 = 1 AND source NOT IN ('src2', 'src4'))),
 files AS (SELECT d.doc_id, d.source, r.rank, doc_id % 3 AS round FROM documents d LEFT JOIN dirs r USING (source) WHERE doc_id % 3 < 2 OR (doc_id % 3 = 2 AND source = 'src0'))
 SELECT concat(source, '/', doc_id) AS path, CASE WHEN round = 0 THEN 'seed' WHEN rank IS NULL THEN 'manual_dir' WHEN rank <= 11 THEN 'submit' ELSE 'later' END AS outcome,
  CASE WHEN round = 1 AND rank > 6 THEN 2 ELSE round END::BIGINT AS round FROM files""")
def r1_discovery_stream(spark, d):
    """Listings that arrive in three rounds, each a new run from the checkpoint: seeds, six folders submitted, then six more of those put off."""
    folder, kept, checkpoint = (shared_path(spark, x) for x in ("listings", "manifest", "r1"))
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.lit("root/x/"), "source").alias("dir"), F.col("doc_id").alias("n"), "source")
    jobs = spark.range(1).selectExpr("explode(array(struct('a/x/src2' AS dir, 2 AS step), struct('a/x/src4' AS dir, 3 AS step))) AS r").select("r.*")
    for which in ("n % 3 = 0", "n % 3 = 1", "n % 3 = 2 AND source = 'src0'"):
        docs.where(which).select("path", "dir").write.mode("append").parquet(folder)
        D.watch(spark.readStream.schema("path string, dir string").parquet(folder), kept, checkpoint, jobs, 10, 6)
    return D.manifest(spark, kept).select("path", "outcome", "round")
