"""The prioritised rule chain that sends an asset to AUTO_PASS, REVIEW or FILTER.

Inputs (columns): yolo_max_conf, dino_max_conf (null: explicit null), has_yolo, has_dino (whether the value was
given at all), yolo_labels, dino_labels, final_tags, ai_tags, vlm_tags_ok, vlm_event_conflict.  A rule
that meets an explicit null confidence cannot be evaluated and is passed over, like a rule whose
threshold is missing from the configuration.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT = {"yolo": 0.7, "dino": 0.6, "conflict": True, "weights": {"yolo": 0.2, "dino": 0.2}}
#: Presets replace the default in parity mode and overlay it otherwise.  Fixed values.
PRESETS = {
    "balanced": DEFAULT,
    "strict": {"yolo": 0.8, "dino": 0.7, "filter_tags": {"weather": ["雪天", "雾天"]}},
    "lenient": {"yolo": 0.5, "dino": 0.4},
    "safety_first": {"yolo": 0.7, "dino": 0.6},
}


def preset(name: str, parity: bool = False, **overrides) -> dict:
    if name not in PRESETS:
        raise ValueError(f"no such preset: {name}")
    return {**({} if parity else DEFAULT), **PRESETS[name], **overrides}


def _named(dim: str, tags: list[str]) -> Column:
    # any() over the final tags, or the machine's where the final map is empty or absent
    effective = F.when(F.coalesce(F.size("final_tags"), F.lit(0)) > 0, F.col("final_tags")).otherwise(F.col("ai_tags"))
    return F.coalesce(F.exists(F.element_at(effective, F.lit(dim)), lambda t: t["tag"].isin(tags)), F.lit(False))


def rules(config: dict) -> list[tuple[str, int, str, Column]]:
    """(name, priority, decision, condition); conditions are never null."""
    yolo, dino, yes = F.col("yolo_max_conf"), F.col("dino_max_conf"), F.lit(True)
    out: list[tuple[str, int, str, Column]] = []

    def value(given: str, conf: Column, missing: float) -> Column:
        return F.when(F.col(given), conf).otherwise(F.lit(missing))

    def surely(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    if config.get("filter_tags"):
        out.append(("business_filter", 100, "FILTER", reduce(lambda a, b: a | b, [_named(d, t) for d, t in config["filter_tags"].items()])))
    if config.get("required_tags"):
        out.append(("missing_required_tags", 90, "REVIEW", reduce(lambda a, b: a | b, [~_named(d, t) for d, t in config["required_tags"].items()])))
    out.append(("event_detection_conflict", 78, "REVIEW", surely(F.col("vlm_event_conflict"))))
    y0, d0 = value("has_yolo", yolo, 0.0), value("has_dino", dino, 0.0)
    tagged = surely(F.col("vlm_tags_ok")) | (F.coalesce(F.size("final_tags"), F.lit(0)) > 0)
    # SQL's three values give the order of evaluation: a null that decides makes the rule null, and so skipped
    out.append(("vlm_only_auto_pass", 75, "AUTO_PASS", surely(F.when(y0.isNull(), None).when(y0 > 0, F.lit(False)).when(d0.isNull(), None).when(d0 > 0, F.lit(False)).otherwise(tagged))))
    both = {"yolo", "dino"} <= set(config)
    y1, d1 = value("has_yolo", yolo, 1.0), value("has_dino", dino, 1.0)
    none = F.array().cast("array<string>")
    ys, ds = F.coalesce(F.col("yolo_labels"), none), F.coalesce(F.col("dino_labels"), none)
    clash = (F.size(ys) > 0) & (F.size(ds) > 0) & ~F.coalesce(F.arrays_overlap(ys, ds), F.lit(False))
    if both:
        out.append(("low_confidence", 70, "REVIEW", surely(F.when(y1.isNull(), None).when(y1 < config["yolo"], yes).when(d1.isNull(), None).otherwise(d1 < config["dino"]))))
    if config.get("conflict"):
        out.append(("model_conflict", 60, "REVIEW", clash))
    if both:
        out.append(("auto_pass", 10, "AUTO_PASS", surely(F.when(y0.isNull(), None).when(y0 < config["yolo"], F.lit(False)).when(d0.isNull(), None).otherwise((d0 >= config["dino"]) & ~clash))))
    if config.get("high_risk_tags"):  # an extension: no rule of the original chain reads risk tags
        out.append(("high_risk", 77, "REVIEW", reduce(lambda a, b: a | b, [_named(d, t) for d, t in config["high_risk_tags"].items()])))
    out.append(("default_review", 0, "REVIEW", yes))
    return sorted(out, key=lambda r: -r[1])


def evidence_score(weights: dict[str, float]) -> Column:
    """The weighted mean of the confidences that are present and positive; null without any."""
    terms = [(F.col(f"{m}_max_conf"), weights[m]) for m in ("yolo", "dino") if weights.get(m)]
    if not terms:
        return F.lit(None).cast("double")
    total = reduce(lambda a, b: a + b, [F.when(c > 0, c * w).otherwise(0.0) for c, w in terms])
    weight = reduce(lambda a, b: a + b, [F.when(c > 0, F.lit(w)).otherwise(0.0) for c, w in terms])
    return F.when(weight > 0, total / weight)


def decide(assets: DataFrame, config: dict) -> DataFrame:
    """Adds decision, rule, priority and score: the first rule that holds, by falling priority."""
    chain = rules(config)
    picked = reduce(lambda c, r: c.when(r[3], F.struct(F.lit(r[2]).alias("decision"), F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("priority"))), chain[1:], F.when(chain[0][3], F.struct(F.lit(chain[0][2]).alias("decision"), F.lit(chain[0][0]).alias("rule"), F.lit(chain[0][1]).alias("priority"))))
    return assets.withColumn("_d", picked).withColumn("score", evidence_score(config.get("weights", {}))).select("*", "_d.decision", "_d.rule", "_d.priority").drop("_d")


def state_after(decision: Column) -> Column:
    """The asset status that a decision leads to; an unknown decision goes to review."""
    return F.when(decision == "AUTO_PASS", F.lit("APPROVED")).when(decision == "FILTER", F.lit("FILTERED")).otherwise(F.lit("REVIEW"))
