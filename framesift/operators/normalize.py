"""Raw model replies as typed rows: parsing, vocabulary checks, relocation, events and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from framesift.functions.jsontext import extracted_of, overlap_share
from framesift.plans.shared import write_shared

UNKNOWN, NO_SIGN = "unknown", "无标识"
REASON_CHARS, ANCHOR_CHARS, MAX_FRAMES, MAX_OBJECTS, MAX_EVENTS = 200, 80, 16, 8, 5
#: Exclusive movements with their priority, least first.  Fixed values.
MOVES = ["车辆变道", "车辆切出", "车辆切入", "车辆加塞"]
#: Object names that belong to another dimension.  Fixed values.
MOVED_OBJECTS = {
    "红绿灯": ("traffic_sign", "交通信号灯"),
    "信号灯": ("traffic_sign", "交通信号灯"),
    "交通灯": ("traffic_sign", "交通信号灯"),
    "交通标识牌": ("traffic_sign", "交通标识牌"),
    "交通设施": ("traffic_sign", "交通标识牌"),
    "指示牌": ("traffic_sign", "交通标识牌"),
    "路牌": ("traffic_sign", "交通标识牌"),
    "标识牌": ("traffic_sign", "交通标识牌"),
    "警示牌": ("traffic_sign", "交通标识牌"),
    "标志牌": ("traffic_sign", "交通标识牌"),
    "斑马线": ("road_marking", "人行横道"),
    "人行横道": ("road_marking", "人行横道"),
}


def unfenced(text: Column) -> Column:
    """Without code fences."""
    return F.trim(F.regexp_replace(text, r"```[A-Za-z]*", ""))


def parsed(replies: DataFrame, schema: str) -> DataFrame:
    """Adds ``doc`` (the reply's first or repaired object in the schema, null where there is none) to (id, text)."""
    return replies.withColumn("doc", F.from_json(extracted_of(unfenced(F.col("text"))), schema))


def as_values(doc: Column, name: str) -> Column:
    """A field of a variant object that may be one string or a list: an array of strings, without other items."""
    many = F.try_variant_get(doc, f"$.{name}", "array<string>")
    one = F.try_variant_get(doc, f"$.{name}", "string")
    return F.when(F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")).startswith("ARRAY"), many).when(one.isNotNull(), F.array(one))


def values_long(rows: DataFrame, key: str, dims: list[str], doc: str = "doc", old_names: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, dim, position, value) of the dimensions of a variant object.  Where a dimension is missing or empty, the first of its
    ``old_names`` that is not stands for it."""

    def given(dim: str) -> Column:
        out = as_values(F.col(doc), dim)
        for old in (old_names or {}).get(dim, []):
            empty = out.isNull() | (F.size(out) == 0) | (out == F.array(F.lit("")))
            out = F.when(empty, as_values(F.col(doc), old)).otherwise(out)
        return out

    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), given(d).alias("v")) for d in dims])
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.dim", F.posexplode("p.v").alias("position", "value")).where("value IS NOT NULL")


def checked_values(values: DataFrame, dim_values: DataFrame, value_aliases: DataFrame, dims: list[str], key: str = "id") -> DataFrame:
    """Values by their official names, in their own dimension or relocated to the alphabetically first one that lists them;
    others are dropped; relocated values follow the dimension's own in the order of ``dims`` they came from; repeats keep the first place; every dimension without any value gets ``unknown``."""
    values = write_shared(values, "reply-values")  # replies are parsed once, for their values and for their keys
    a = value_aliases.select(F.col("dim").alias("_ad"), F.col("alias").alias("_a"), F.col("value").alias("_av"))
    named = values.join(a, (F.col("dim") == F.col("_ad")) & (F.col("value") == F.col("_a")), "left").withColumn("value", F.coalesce("_av", "value")).drop("_ad", "_a", "_av")
    listed = dim_values.where(F.col("dim").isin(dims)).groupBy(F.col("value").alias("_v")).agg(F.collect_set("dim").alias("_dims"))
    placed = named.join(listed, F.col("value") == F.col("_v")).withColumn("_own", F.array_contains("_dims", F.col("dim")))
    placed = placed.withColumn("_from", F.array_position(F.array(*[F.lit(d) for d in dims]), F.col("dim"))).withColumn("dim", F.when(F.col("_own"), F.col("dim")).otherwise(F.array_min("_dims")))
    kept = placed.where(F.col("dim").isin(dims)).groupBy(key, "dim", "value").agg(F.min(F.struct((~F.col("_own")).alias("moved"), "_from", "position")).alias("_at"))
    real = kept.withColumn("_n", F.count_if(F.col("value") != UNKNOWN).over(W.partitionBy(key, "dim"))).where((F.col("value") != UNKNOWN) | (F.col("_n") == 0))
    grouped = real.groupBy(key, "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]).alias("tags"))
    grid = values.select(key).distinct().withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims])))
    # both sides have a row for every key; the written values take so few bytes a row that Spark would broadcast one of them
    return grid.join(grouped.hint("merge"), [key, "dim"], "left").withColumn("tags", F.coalesce("tags", F.array(F.lit(UNKNOWN))))


def sign_tags(tags: Column) -> Column:
    """Traffic signs: unknown and nothing become "none"."""
    named = F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.when(t == UNKNOWN, F.lit(NO_SIGN)).otherwise(t)))
    return F.when(F.size(named) == 0, F.array(F.lit(NO_SIGN))).otherwise(named)


def risk_tags(tags: Column) -> Column:
    """Risks without repeats; nothing becomes "unknown"."""
    named = F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))
    return F.when(F.size(named) == 0, F.array(F.lit(UNKNOWN))).otherwise(named)


def ego_states(states: Column, vocabulary: list[str]) -> Column:
    """The states that the vocabulary lists; ``unknown`` where none is."""
    known = F.filter(F.coalesce(states, F.array().cast("array<string>")), lambda x: x.isin(vocabulary))
    return F.when(F.size(known) == 0, F.array(F.lit(UNKNOWN))).otherwise(known)


def confidence(text: Column) -> Column:
    """A whole number text, or a list's first item; anything else 0."""
    first = F.when(text.rlike(r"^\s*\["), F.regexp_extract(text, r"^\s*\[\s*\"?([^\",\]]*)", 1)).otherwise(text)
    number = F.trim(first)
    is_number = number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.coalesce(F.when(is_number, number.try_cast("double")), F.lit(0.0))


def checked_events(events: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events of the vocabulary by their official type; reason and anchor trimmed and cut to their longest."""

    def cut(name: str, most: int) -> Column:
        return F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", ""), 1, most)

    known = official(events, aliases).join(vocabulary.select(F.col("value").alias("type")).distinct(), "type", "left_semi")
    return known.withColumn("reason", cut("reason", REASON_CHARS)).withColumn("anchor", cut("anchor", ANCHOR_CHARS))


def official(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows with ``type`` by its official name."""
    a = aliases.select(F.col("alias").alias("_a"), F.col("value").alias("_v"))
    return rows.join(a, F.col("type") == F.col("_a"), "left").withColumn("type", F.coalesce("_v", "type")).drop("_a", "_v")


def deduplicated_events(events: DataFrame, key: str = "id") -> DataFrame:
    """One of equal (type, anchor, reason) events, the first; and of three or more exclusive movements at one anchor only the
    surest (then by priority, then the first)."""
    equal = events.groupBy(key, "type", F.trim("anchor").alias("_a"), F.trim("reason").alias("_b"))
    once = equal.agg(F.min_by(F.struct(*events.columns), F.struct("position")).alias("_e")).select("_e.*")  # combined before the shuffle
    exclusive = F.col("type").isin(MOVES) & (F.trim("anchor") != "")
    group = W.partitionBy(key, F.trim("anchor"), exclusive)
    rank = F.row_number().over(group.orderBy(F.desc("confidence"), F.desc(F.array_position(F.array(*[F.lit(m) for m in MOVES]), F.col("type"))), "position"))
    counted = once.withColumn("_x", exclusive).withColumn("_n", F.count("*").over(group)).withColumn("_k", rank)
    return counted.where(~F.col("_x") | (F.col("_n") < 3) | (F.col("_k") == 1)).drop("_x", "_n", "_k")


def best(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` surest rows of a key; equal ones in their order."""
    order = W.partitionBy(key).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "position")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def moved_objects(objects: DataFrame, vocabulary: DataFrame, key: str = "id", aliases: DataFrame | None = None, states: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects of the vocabulary, the top ones; values moved to other dimensions as (key, dim, value)).

    Aliases are resolved first.  A missing confidence stays missing and ranks like 0; of a column ``state`` only ``states`` stay.
    """
    table = F.create_map(*[x for name, (d, v) in MOVED_OBJECTS.items() for x in (F.lit(name), F.struct(F.lit(d).alias("dim"), F.lit(v).alias("value")))])
    named = objects if aliases is None else official(objects, aliases)
    if states is not None:
        named = named.withColumn("state", F.when(F.col("state").isin(states), F.col("state")))
    routed = named.withColumn("_m", F.try_element_at(table, F.col("type")))
    moved = routed.where("_m IS NOT NULL").select(key, "_m.dim", "_m.value").distinct()
    kept = routed.where("_m IS NULL").drop("_m").join(vocabulary.select(F.col("value").alias("type")).distinct(), "type", "left_semi")
    return best(kept, key, MAX_OBJECTS), moved


#: A frame's number before what is seen in it.
FRAME_MARK = r"F[0-9]+\s*[:：]?\s*"


def reason_flags(events: DataFrame, anchors: str, things: str, boiler: str, criteria: DataFrame, least: float = 0.45) -> DataFrame:
    """Adds generic (no anchor word in anchor, reason or evidence, frame numbers apart), boiler (a stock phrase with fewer than two
    different ``things``), weak (fewer than two frame numbers), copies_criteria (a run of at least ``least`` of the text stands in the
    type's criterion) and repeat (two equal pieces of evidence).

    ``events`` has type, reason, anchor and evidence (an array); each may be null.
    """
    c = criteria.select(F.col("type").alias("_t"), F.col("text").alias("_c"))
    pieces = F.coalesce("evidence", F.array().cast("array<string>"))
    raw = F.trim(F.array_join(F.concat(F.array(F.coalesce("reason", F.lit(""))), pieces), " "))
    rows = events.join(c, F.col("type") == F.col("_t"), "left").withColumn("_raw", raw).withColumn("_text", F.trim(F.regexp_replace("_raw", FRAME_MARK, "")))
    seen = F.concat_ws(" ", F.coalesce("anchor", F.lit("")), "_text")
    found = F.array_distinct(F.regexp_extract_all(seen, F.lit(f"({things})"), 1))
    marks = F.size(F.regexp_extract_all("_raw", F.lit("(F[0-9]+)"), 1))
    copied = F.coalesce(overlap_share(F.col("_text"), F.coalesce("_c", F.lit(""))), F.lit(0.0)) >= least
    return rows.select(
        *events.columns, (~seen.rlike(anchors)).alias("generic"), (seen.rlike(boiler) & (F.size(found) < 2)).alias("boiler"), (marks < 2).alias("weak"),
        copied.alias("copies_criteria"), (F.size(F.array_distinct(pieces)) < F.size(pieces)).alias("repeat"),
    )


def evidence_flags(frames: Column, anchors: str) -> Column:
    """struct(repeat, generic) of frame notes, frame numbers and blanks apart: any two alike; more than half without an anchor word."""
    notes = F.transform(F.coalesce(frames, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"^F[0-9]+\s*[:：]\s*", "")))
    notes = F.filter(notes, lambda x: x != "")
    plain = F.filter(notes, lambda x: ~x.rlike(anchors))
    return F.struct((F.size(F.array_distinct(notes)) < F.size(notes)).alias("repeat"), (F.size(plain) * 2 > F.size(notes)).alias("generic"))


def frame_notes(items: Column) -> Column:
    """Trimmed notes without blanks, at most sixteen."""
    return F.slice(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, MAX_FRAMES)
