"""Evaluation of predicted tags and detector hits against ground truth.

Tag rows are (asset_id, dim, tag), distinct; prediction rows also carry ``model``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DIMS = ["time", "weather", "road", "objects", "events", "risk"]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, each 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def asset_dim_metrics(truth: DataFrame, predicted: DataFrame, dims: list[str]) -> DataFrame:
    """tp, fp, fn and 4-digit precision, recall and f1 of every (model, asset, dim) for each asset of the truth that the
    model predicted anything for; dimensions without either tag score 0."""
    t = truth.where(F.col("dim").isin(dims)).select("asset_id", "dim", "tag").distinct()
    p = predicted.where(F.col("dim").isin(dims)).select("model", "asset_id", "dim", "tag").distinct()
    pairs = p.select("model", "asset_id").distinct().join(t.select("asset_id").distinct(), "asset_id")
    grid = pairs.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))
    want = pairs.join(t, "asset_id").select("model", "asset_id", "dim", "tag", F.lit(1).alias("g"), F.lit(0).alias("p"))
    got = p.join(pairs, ["model", "asset_id"], "left_semi").select("model", "asset_id", "dim", "tag", F.lit(0).alias("g"), F.lit(1).alias("p"))
    per_tag = want.union(got).groupBy("model", "asset_id", "dim", "tag").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = per_tag.groupBy("model", "asset_id", "dim").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    full = grid.join(counts, ["model", "asset_id", "dim"], "left").na.fill(0, ["tp", "fp", "fn"])
    precision, recall, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return full.select("model", "asset_id", "dim", "tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def pooled(metrics: DataFrame) -> DataFrame:
    """Per (model, asset): counts over all dimensions, and their precision, recall and f1."""
    sums = metrics.groupBy("model", "asset_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision, recall, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("model", "asset_id", "tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def summary(pooled_metrics: DataFrame) -> DataFrame:
    """Per model: the number of assets and means of the rounded per-asset figures."""
    return pooled_metrics.groupBy("model").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def dim_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model", "dim").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def fused(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of several prediction tables' tags, as model ``fusion``."""
    out = first.select("asset_id", "dim", "tag")
    for o in others:
        out = out.union(o.select("asset_id", "dim", "tag"))
    return out.distinct().select(F.lit("fusion").alias("model"), "asset_id", "dim", "tag")


def merged_names(predictions: DataFrame) -> DataFrame:
    """(asset_id, dim, tags): the sorted distinct names of all models."""
    return predictions.groupBy("asset_id", "dim").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


HIGH, LOW = 0.25, 0.15


def hit_rates(scores: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Per (model, grp): frames, segments and the shares with a score from ``high`` on, and from ``low`` to ``high``.

    ``scores``: model, grp, segment, frame, score (a frame's best).  A segment has its best frame's score.
    """
    h, weak = (F.col("score") >= high), (F.col("score") >= low) & (F.col("score") < high)
    segments = scores.groupBy("model", "grp", "segment").agg(F.max("score").alias("score"), F.count("*").alias("frames"), F.sum(h.cast("long")).alias("fh"), F.sum(weak.cast("long")).alias("fw"))
    return segments.groupBy("model", "grp").agg(
        F.sum("frames").alias("n_frames"), F.count("*").alias("n_segments"), F.sum("fh").alias("frames_high"), F.sum("fw").alias("frames_low"),
        F.sum(h.cast("long")).alias("segments_high"), F.sum(weak.cast("long")).alias("segments_low"),
        F.round(F.sum("fh") / F.sum("frames"), 4).alias("frame_rate"), F.round(F.avg(h.cast("double")), 4).alias("segment_rate"),
    )


def quadrants(old: DataFrame, new: DataFrame, keys: list[str], threshold: float = HIGH) -> DataFrame:
    """Counts of both / old_only / new_only / none over frames of either model (columns keys, score)."""
    a = old.groupBy(*keys).agg((F.max("score") >= threshold).alias("o"))
    b = new.groupBy(*keys).agg((F.max("score") >= threshold).alias("n"))
    o, n = F.coalesce("o", F.lit(False)), F.coalesce("n", F.lit(False))
    name = F.when(o & n, "both").when(o, "old_only").when(n, "new_only").otherwise("none")
    return a.join(b, keys, "full").select(*keys, name.alias("quadrant"))


def class_quadrants(classes: DataFrame, frames: DataFrame, old: DataFrame, new: DataFrame, threshold: float = HIGH) -> DataFrame:
    """Per class (a small table): counts of each quadrant over all frames.  Frames without a hit are counted, not paired with classes."""
    quads = quadrants(old, new, ["cls", "frame"], threshold).groupBy("cls").pivot("quadrant", ["both", "old_only", "new_only"]).count()
    total = frames.agg(F.count("*").alias("n_frames"))
    joined = classes.join(quads, "cls", "left").na.fill(0, ["both", "old_only", "new_only"]).crossJoin(F.broadcast(total))
    seen = F.col("both") + F.col("old_only") + F.col("new_only")
    gain = F.when(F.col("new_only") > F.col("old_only"), "up").when(F.col("new_only") < F.col("old_only"), "down").otherwise("same")
    return joined.select("cls", "both", "old_only", "new_only", (F.col("n_frames") - seen).alias("none"), gain.alias("direction"))


def class_hits(old: DataFrame, new: DataFrame, threshold: float = HIGH) -> DataFrame:
    """Per class that either model hits: frames and segments hit by each, and the segments' rates over all segments.

    ``old`` and ``new``: segment, frame, cls, score.
    """
    scored = old.select("segment", "frame", "cls", "score", F.lit("old").alias("_m")).union(new.select("segment", "frame", "cls", "score", F.lit("new").alias("_m")))
    total = scored.agg(F.count_distinct("segment").alias("n_segments"))
    hit = F.col("score") >= threshold

    def best(model: str) -> Column:
        return F.max(F.when(F.col("_m") == model, hit.cast("int")).otherwise(0))

    frames = scored.groupBy("cls", "segment", "frame").agg(best("old").alias("o"), best("new").alias("n"))
    segments = frames.groupBy("cls", "segment").agg(F.sum("o").alias("fo"), F.sum("n").alias("fn"), F.max("o").alias("so"), F.max("n").alias("sn"))
    counts = segments.groupBy("cls").agg(F.sum("fo").alias("frames_old"), F.sum("fn").alias("frames_new"), F.sum("so").alias("segments_old"), F.sum("sn").alias("segments_new"))
    rated = counts.where("frames_old > 0 OR frames_new > 0").crossJoin(F.broadcast(total))
    return rated.select("cls", "frames_old", "frames_new", "segments_old", "segments_new", *[F.round(F.col(f"segments_{m}") / F.col("n_segments"), 4).alias(f"segment_rate_{m}") for m in ("old", "new")])


def segment_values(hits: DataFrame, names: dict[str, str], none: str = "无标识") -> DataFrame:
    """Per (segment, model): the sorted class names, mapped where a name is given, joined by 、, or ``none``."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    sets = hits.groupBy("segment", "model").agg(F.array_sort(F.collect_set(F.coalesce(F.try_element_at(table, F.col("cls")), F.col("cls")))).alias("values"))
    return sets.select("segment", "model", F.when(F.size("values") > 0, F.array_join("values", "、")).otherwise(F.lit(none)).alias("value"))


def deploy_check(detections: DataFrame) -> DataFrame:
    """Per (weight, cls): boxes and the highest confidence."""
    return detections.groupBy("weight", "cls").agg(F.count("*").alias("n"), F.max("conf").alias("max_conf"))


def epoch_matrix(metrics: DataFrame, value: str, epochs: list[int]) -> DataFrame:
    """One row per class, one column per epoch."""
    return metrics.groupBy("cls").pivot("epoch", epochs).agg(F.first(value, ignorenulls=True))


def hard_cases(diffs: DataFrame, status: str = "NEW") -> DataFrame:
    """One row per asset with a difference of machine and human tags (asset_id, dim, only_ai, only_human, both): case_id, diff by
    dimension and status.  A case's id follows from its asset, so a repeated run appends no second one where ids are unique."""
    diff = F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", F.struct("only_ai", "only_human", "both")))))
    return diffs.groupBy("asset_id").agg(diff.alias("diff")).select(F.substring(F.sha2(F.col("asset_id").cast("string"), 256), 1, 16).alias("case_id"), "asset_id", "diff", F.lit(status).alias("status"))


def listed_cases(cases: DataFrame, project: str, status: str | None = None) -> DataFrame:
    """A project's cases, of one status or of any, newest first."""
    own = cases.where(F.col("project") == project)
    return (own if status is None else own.where(F.col("status") == status)).orderBy(F.desc("created_at"), "case_id")


def benchmark_samples(samples: DataFrame, project: str, split: str | None = None) -> DataFrame:
    """A project's benchmark samples, of one split or of all."""
    own = samples.where(F.col("project") == project)
    return own if split is None else own.where(F.col("split") == split)
