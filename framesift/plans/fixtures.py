"""The given tables seen as catalog rows, tags, frames, boxes and model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framesift.plans.registry import table

LENGTH = "CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END"
STATUS = "CASE WHEN quality IS NULL THEN 'EMBEDDED' WHEN quality = 0 THEN 'FILTERED' WHEN toxic = 1 THEN 'REVIEW' ELSE 'APPROVED' END"
#: The same rows in SQL: one per document with its labels.
ASSETS = f"""assets AS (SELECT d.doc_id AS id, concat('a', d.doc_id) AS asset_id, d.source AS project, concat('s', d.doc_id % 50) AS source_id, lang, n_chars,
  {LENGTH} AS length, quality, toxic, {STATUS} AS status, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS qtag
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
#: Occurrences of effective tags (final where given, else machine), and all tags of either layer.
EFFECTIVE = """effective AS (SELECT id, status, source_id, 'lang' AS dim, lang AS tag FROM assets UNION ALL SELECT id, status, source_id, 'length', length FROM assets WHERE quality IS NULL
  UNION ALL SELECT id, status, source_id, 'quality', qtag FROM assets WHERE quality IS NOT NULL)"""
MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
TAG = "struct<tag:string,source:string,confidence:double>"


def tag(value, source: str = "AI", confidence: float = 0.9):
    return F.array(F.struct(value.alias("tag"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence")))


def assets(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "_l")
    docs = table(spark, d, "documents")
    rows = docs.join(labels, docs["doc_id"] == labels["_l"], "left").selectExpr(
        "doc_id AS id", "concat('a', doc_id) AS asset_id", "source AS project", "concat('s', doc_id % 50) AS source_id", "lang", "n_chars", f"{LENGTH} AS length",
        "quality", "toxic", f"{STATUS} AS status", "CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS qtag",
    )
    ai = F.create_map(F.lit("lang"), tag(F.col("lang")), F.lit("length"), tag(F.col("length")))
    final = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("lang"), tag(F.col("lang")), F.lit("quality"), tag(F.col("qtag"), "Human", 1.0))).otherwise(F.create_map().cast(f"map<string,array<{TAG}>>"))
    return rows.withColumn("ai_tags", ai).withColumn("final_tags", final)


def events_ms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ms", F.expr(MS))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Frame file names of six shapes by event_id, as (id, path, position).  Numbers are padded to six digits, longer ones stay whole."""
    name = F.expr("""CASE event_id % 6
      WHEN 0 THEN concat('images/vid', user_id, '/vid', user_id, '_', event_id, '.jpg')
      WHEN 1 THEN concat('images/v', user_id % 9, '_', 1000 * event_id, '_', event_id, '.jpg')
      WHEN 2 THEN concat('images/', event_id, '_', 1700000000000 + 900 * event_id, '_', user_id % 3, '.jpg')
      WHEN 3 THEN concat('cam/', 1700000000 + event_id, '.', event_id % 997, '.jpg')
      WHEN 4 THEN concat('img/IMG_', lpad(cast(event_id AS string), greatest(6, length(cast(event_id AS string))), '0'), '.jpg')
      ELSE concat('img/photo', event_type, '.png') END""")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), name.alias("path"), F.col("event_id").alias("position"))


FRAMES = """frames AS (SELECT event_id AS id, CASE event_id % 6
      WHEN 0 THEN concat('images/vid', user_id, '/vid', user_id, '_', event_id, '.jpg')
      WHEN 1 THEN concat('images/v', user_id % 9, '_', 1000 * event_id, '_', event_id, '.jpg')
      WHEN 2 THEN concat('images/', event_id, '_', 1700000000000 + 900 * event_id, '_', user_id % 3, '.jpg')
      WHEN 3 THEN concat('cam/', 1700000000 + event_id, '.', event_id % 997, '.jpg')
      WHEN 4 THEN concat('img/IMG_', lpad(cast(event_id AS varchar), 6, '0'), '.jpg')
      ELSE concat('img/photo', event_type, '.png') END AS path, event_id AS position FROM events)"""


def decision_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as detector evidence: confidences from discount and tax, labels from the flags."""
    lines = table(spark, d, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS asset_id", "CASE WHEN l_linenumber = 7 THEN NULL ELSE round(0.5 + l_discount * 5, 4) END AS yolo_max_conf",
        "round(0.4 + l_tax * 6, 4) AS dino_max_conf", "l_linenumber <> 6 AS has_yolo", "l_linenumber NOT IN (5, 6) AS has_dino", "array(l_returnflag) AS yolo_labels",
        "array(CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END) AS dino_labels", "l_quantity > 25 AS vlm_tags_ok", "l_quantity = 50 AS vlm_event_conflict",
        "CASE WHEN l_quantity < 5 THEN '雪天' ELSE '晴天' END AS weather",
    )
    return lines.withColumn("ai_tags", F.create_map(F.lit("weather"), tag(F.col("weather")))).withColumn("final_tags", F.create_map().cast(f"map<string,array<{TAG}>>"))


DECISIONS = """ins AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS asset_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE round(0.5 + l_discount * 5, 4) END AS y, round(0.4 + l_tax * 6, 4) AS d,
  l_linenumber AS n, l_returnflag AS yl, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS dl, l_quantity > 25 AS ok, l_quantity = 50 AS conflict, l_quantity < 5 AS snow FROM lineitem)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as pixel boxes of images of 1920 x 1080, one image an order."""
    return table(spark, d, "lineitem").selectExpr(
        "concat('img', l_orderkey) AS image_id", "1920 AS img_w", "1080 AS img_h", "l_returnflag AS cls", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp",
        "cast((l_partkey * 37) % 1700 AS double) AS x0", "cast((l_suppkey * 53) % 900 AS double) AS y0",
        "cast((l_partkey * 37) % 1700 + 5 + l_quantity * 3 AS double) AS x1", "cast((l_suppkey * 53) % 900 + 4 + l_quantity * 2 AS double) AS y1", "round(l_discount * 10, 4) AS conf",
    )


BOXES = """boxes AS (SELECT concat('img', l_orderkey) AS image_id, 1920 AS img_w, 1080 AS img_h, l_returnflag AS cls, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
  cast((l_partkey * 37) % 1700 AS double) AS x0, cast((l_suppkey * 53) % 900 AS double) AS y0,
  cast((l_partkey * 37) % 1700 + 5 + l_quantity * 3 AS double) AS x1, cast((l_suppkey * 53) % 900 + 4 + l_quantity * 2 AS double) AS y1, round(l_discount * 10, 4) AS conf FROM lineitem)"""


def predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Truth from labels and predictions of three models by rules over the documents, in long form."""
    a = assets(spark, d)
    truth = a.where("quality IS NOT NULL").select("asset_id", F.explode(F.expr("array(struct('quality' AS dim, qtag AS tag), struct('toxic' AS dim, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS tag))")).alias("t")).select("asset_id", "t.*")
    rules = F.expr("""array(struct('size' AS model, 'quality' AS dim, CASE WHEN n_chars > 800 THEN 'good' ELSE 'bad' END AS tag), struct('lang' AS model, 'quality' AS dim, CASE WHEN lang = 'en' THEN 'good' ELSE 'bad' END AS tag),
      struct('lang' AS model, 'toxic' AS dim, CASE WHEN lang = 'de' THEN 'toxic' ELSE 'clean' END AS tag), struct('parity' AS model, 'toxic' AS dim, CASE WHEN id % 7 = 0 THEN 'toxic' ELSE 'clean' END AS tag))""")
    return truth, a.select("asset_id", F.explode(rules).alias("r")).select("r.model", "asset_id", "r.dim", "r.tag")


PREDICTIONS = ASSETS + """, truth AS (SELECT asset_id, 'quality' AS dim, qtag AS tag FROM assets WHERE quality IS NOT NULL UNION ALL
   SELECT asset_id, 'toxic', CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END FROM assets WHERE quality IS NOT NULL),
  predicted AS (SELECT 'size' AS model, asset_id, 'quality' AS dim, CASE WHEN n_chars > 800 THEN 'good' ELSE 'bad' END AS tag FROM assets UNION ALL
   SELECT 'lang', asset_id, 'quality', CASE WHEN lang = 'en' THEN 'good' ELSE 'bad' END FROM assets UNION ALL
   SELECT 'lang', asset_id, 'toxic', CASE WHEN lang = 'de' THEN 'toxic' ELSE 'clean' END FROM assets UNION ALL
   SELECT 'parity', asset_id, 'toxic', CASE WHEN id % 7 = 0 THEN 'toxic' ELSE 'clean' END FROM assets)"""
#: tp, fp and fn of every (model, asset, dim), dims without tags included.
METRICS = PREDICTIONS + """, pairs AS (SELECT DISTINCT model, asset_id FROM predicted WHERE asset_id IN (SELECT asset_id FROM truth)),
  grid AS (SELECT model, asset_id, dim FROM pairs, (VALUES ('quality'), ('toxic'), ('risk')) AS v(dim)),
  counted AS (SELECT g.model, g.asset_id, g.dim,
    (SELECT count(*) FROM predicted p WHERE p.model = g.model AND p.asset_id = g.asset_id AND p.dim = g.dim AND EXISTS (SELECT 1 FROM truth t WHERE t.asset_id = p.asset_id AND t.dim = p.dim AND t.tag = p.tag)) AS tp,
    (SELECT count(*) FROM predicted p WHERE p.model = g.model AND p.asset_id = g.asset_id AND p.dim = g.dim) AS np,
    (SELECT count(*) FROM truth t WHERE t.asset_id = g.asset_id AND t.dim = g.dim) AS nt FROM grid g),
  metrics AS (SELECT model, asset_id, dim, tp, np - tp AS fp, nt - tp AS fn, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN nt > 0 THEN tp / nt ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2.0 * tp / (np + nt) ELSE 0 END AS f1 FROM counted)"""


def arrivals(rows: DataFrame, ms: str, batches: int, jitter_ms: int, folder: str, files: int = 2) -> None:
    """Rows as files that arrive in ``batches`` by time, each row up to ``jitter_ms`` late; then one row a hundred days ahead, which moves the watermark
    past all of them (its other columns are null)."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min(ms), F.max(ms)).first()
    if low is None:
        low = high = 0
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(jitter_ms))
    dealt = rows.withColumn("_batch", F.least(F.lit(batches - 1), ((F.col(ms) - low + late) / ((high - low) // batches + 1)).cast("int")))
    for number in range(batches):
        dealt.where(F.col("_batch") == number).drop("_batch").repartition(files).write.mode("append").parquet(folder)
    ahead = spark.range(1).select(*[(F.lit(high + 100 * 86_400_000) if c == ms else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
    ahead.write.mode("append").parquet(folder)


def arriving(spark: SparkSession, schema: str, ms: str, folder: str, files: int = 2) -> DataFrame:
    """The stream of what ``arrivals`` wrote, with ``ms`` as the timestamp ``ts``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.timestamp_millis(ms))
