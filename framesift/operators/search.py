"""Projections, filters, searches, orders and pages over catalog rows.

Tags are ``map<string, array<struct<tag, source, confidence, ...>>>``; operators on tag names take the map's columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framesift.functions.paths import basename

PROCESSED = ["EMBEDDED", "DETECTED", "UNDERSTOOD", "TAGGED", "REVIEW", "APPROVED"]
#: Pixel counts from which an image counts as 8M or 2M.
PIXELS_8M, PIXELS_2M = 8_000_000, 1_800_000


def tags_of(tags: Column, dim: str) -> Column:
    """The tag structs of one dimension; no map or no dimension: an empty array."""
    found = F.element_at(tags, F.lit(dim))
    return F.coalesce(found, F.slice(found, 1, 0), F.array())


def tag_names(tags: Column, dim: str) -> Column:
    """Distinct trimmed tag names of one dimension, in order, without blanks."""
    names = F.transform(F.element_at(tags, F.lit(dim)), lambda t: F.trim(t["tag"]))
    return F.array_distinct(F.coalesce(F.filter(names, lambda n: n.isNotNull() & (n != "")), F.array().cast("array<string>")))


def tag_match(columns: list[Column], filters: dict[str, list[str]]) -> Column:
    """Whether, for every dimension, any of the columns' tags is one of its listed values; blank values and
    empty lists do not count, and no filter at all matches everything."""
    tests = []
    for dim, values in filters.items():
        wanted = [v for v in values if isinstance(v, str) and v.strip()] if isinstance(values, list) else []
        if wanted:
            each = [F.coalesce(F.exists(F.element_at(c, F.lit(dim)), lambda t: t["tag"].isin(wanted)), F.lit(False)) for c in columns]
            tests.append(reduce(lambda a, b: a | b, each))
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def search(assets: DataFrame, filters: dict[str, list[str]], status: str | None = None) -> DataFrame:
    found = assets.where(tag_match([F.col("final_tags"), F.col("ai_tags")], filters))
    return found.where(F.col("status") == status) if status else found


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def tag_hits(assets: DataFrame, filters: dict[str, list[str]], columns: list[str], most: int = 100_000) -> DataFrame:
    if unknown := [c for c in columns if c not in assets.columns]:
        raise ValueError(f"no such columns: {unknown}")
    return search(assets, filters).orderBy("id").select(*columns).limit(most)


def listing(rows: DataFrame, order: list, **wanted: str | None) -> DataFrame:
    """Rows with the given values; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(*order)


def lookup(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def review_queue(assets: DataFrame, high_risk: bool = False, conflicts: bool = False) -> DataFrame:
    found = assets.where("status = 'REVIEW'")
    if high_risk:
        found = found.where(F.get_json_object("final_result", "$.risk") == "high")
    return found.where(F.col("reason").contains("冲突")) if conflicts else found


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words; no words: true."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(True)


def valid_box(w: Column, h: Column, normalised: bool = True, least_area: float = 1e-5, least_side: float = 4.0) -> Column:
    """Box sizes that count: normalised ones within the image and not tiny, or pixels of at least four a side."""
    if normalised:
        return (w > 0) & (h > 0) & (w <= 1) & (h <= 1) & (w * h >= least_area)
    return (w >= least_side) & (h >= least_side)


def visible(exterior: Column, out_of_frame: Column) -> Column:
    return ~F.coalesce(exterior, F.lit(False)) & ~F.coalesce(out_of_frame, F.lit(False))


def judged_class(values: Column, frames: Column, none: str = "无标识", unknown: str = "unknown") -> Column:
    """A: a real value was judged; B: only "none"; null: not judged or no frames."""
    real = F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "") & (v != unknown))
    judged = (F.coalesce(F.size(frames), F.lit(0)) > 0) & (F.coalesce(F.size(real), F.lit(0)) > 0)
    return F.when(judged & F.exists(real, lambda v: v != none), F.lit("A")).when(judged, F.lit("B"))


def resize_plan(width: Column, height: Column, longest: int) -> Column:
    """struct(width, height) after limiting the longer side; null where nothing is to do."""
    side = F.greatest(width, height)
    scale = F.lit(longest) / side
    return F.when(side > longest, F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height")))


def resolution(width: Column, height: Column) -> Column:
    pixels = width.cast("long") * height
    return F.when(width > 0, F.when(pixels >= PIXELS_8M, F.lit("8M")).when(pixels >= PIXELS_2M, F.lit("2M")).otherwise(F.lit("其他")))


def undecided(clips: DataFrame, most: int = 100) -> DataFrame:
    return clips.where("decision IS NULL OR decision = ''").orderBy("clip_id").limit(most)


def export_rows(assets: DataFrame, dims: list[str]) -> DataFrame:
    """Nested export rows: tag names of each dimension (an empty final map gives all dimensions with none) and the resolution."""

    def names(tags: Column) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(d) for d in dims]), F.array(*[tag_names(tags, d) for d in dims]))

    business = F.when(
        ~F.map_contains_key("business", F.lit("resolution")) & resolution(F.col("width"), F.col("height")).isNotNull(),
        F.map_concat("business", F.create_map(F.lit("resolution"), F.coalesce(resolution(F.col("width"), F.col("height")), F.lit("")))),
    ).otherwise(F.col("business"))
    return assets.select(
        "asset_id", "image_path", F.struct("source_id", "directory_chain").alias("source"), F.struct("frame_index", "timestamp").alias("frame"),
        business.alias("business"), names(F.col("ai_tags")).alias("ai_tags"), names(F.col("final_tags")).alias("final_tags"),
        F.struct("status", "decision_score").alias("final"),
    )


def flat_rows(exported: DataFrame, dims: list[str]) -> DataFrame:
    """Flat export rows: the chain joined by /, each dimension's final tags by |."""
    return exported.select(
        "asset_id", "image_path", F.concat_ws("/", "source.directory_chain").alias("chain"), F.coalesce(F.col("business")["resolution"], F.lit("")).alias("resolution"),
        F.col("final.status").alias("status"), *[F.concat_ws("|", F.col("final_tags")[d]).alias(d) for d in dims],
    )


def sharded_name(asset_id: Column, path: Column) -> Column:
    return F.concat(F.substring(asset_id, 1, 8), F.lit("_"), basename(path))
