"""Tag algebra: merging machine and human tags, ontology checks, conflicts and statistics.

Long form: one row per tag with asset_id, dim, tag, source, confidence, position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def long_tags(assets: DataFrame, column: str, key: str = "asset_id") -> DataFrame:
    """The long form of a tag map; bare or blank tags of a null name are left out."""
    each = assets.select(key, F.explode(column).alias("dim", "tags")).select(key, "dim", F.posexplode("tags").alias("position", "t"))
    return each.select(key, "dim", "position", F.col("t.tag").alias("tag"), F.col("t.source").alias("source"), F.col("t.confidence").alias("confidence")).where("tag IS NOT NULL")


def merged(tags: DataFrame, keys: tuple[str, ...] = ("asset_id", "dim")) -> DataFrame:
    """One row per (tag, source) with its highest confidence, at its first position."""
    return tags.groupBy(*keys, "tag", "source").agg(F.max("confidence").alias("confidence"), F.min("position").alias("position"))


def machine_tags(rows: DataFrame, dims: list[str], doc: str = "doc", key: str = "asset_id") -> DataFrame:
    """The long form of a variant object {dim: [tag, ...]} of machine tags with their model.

    A tag is an object (tag, source, confidence, model) or a bare string, which counts as surely seen by an unknown model; other items are
    left out, and so are objects without a name.
    """
    each = F.array(*[F.struct(F.lit(d).alias("dim"), F.try_variant_get(doc, f"$.{d}", "array<variant>").alias("items")) for d in dims])
    items = rows.select(key, F.explode(each).alias("e")).select(key, "e.dim", F.posexplode("e.items").alias("position", "v"))
    bare = F.schema_of_variant("v") == "STRING"

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", kind)

    named = items.select(
        key, "dim", "position", F.when(bare, F.try_variant_get("v", "$", "string")).otherwise(field("tag", "string")).alias("tag"), F.coalesce(field("source", "string"), F.lit("AI")).alias("source"),
        F.coalesce(field("confidence", "double"), F.lit(1.0)).alias("confidence"), F.coalesce(field("model", "string"), F.lit("unknown")).alias("model"),
    )
    return named.where("tag IS NOT NULL")


def tags_by_source(tags: Column, source: str) -> Column:
    """The tag structs of one source."""
    return F.filter(tags, lambda t: t["source"] == source)


def without_tag(tags: Column, name: str, source: str | None = None) -> Column:
    """The tag structs less those of a name, of one source or of any."""
    return F.filter(tags, lambda t: ~((t["tag"] == name) & (F.lit(True) if source is None else t["source"] == source)))


def scene_categories(ontology: DataFrame, legacy: DataFrame) -> DataFrame:
    """(category, details, focus) of an ontology's array ``scene_categories``; of the legacy table's where the ontology has none."""
    own = ontology.select(F.explode("scene_categories").alias("c")).select("c.category", "c.details", "c.focus")
    old = legacy.select(F.explode("scene_categories").alias("c")).select("c.category", "c.details", "c.focus")
    none = own.limit(1).agg((F.count("*") == 0).alias("_none"))
    return own.unionByName(old.crossJoin(F.broadcast(none)).where("_none").drop("_none"))


def human_tags(rows: DataFrame, tag: str = "tag") -> DataFrame:
    return rows.select("*").withColumn("source", F.lit("Human")).withColumn("confidence", F.lit(1.0))


def final_tags(machine: DataFrame, human: DataFrame) -> DataFrame:
    """Machine tags less those of AI source that a human tag of the same name replaces, and the human tags."""
    names = human.select("asset_id", "dim", "tag").distinct()
    replaced = machine.where("source = 'AI'").join(names, ["asset_id", "dim", "tag"], "left_anti")
    return replaced.unionByName(machine.where("source <> 'AI'")).unionByName(human)


def conflicts(machine: DataFrame, human: DataFrame) -> DataFrame:
    """Per asset and dimension with any difference: only_ai, only_human and both, sorted."""
    a = machine.groupBy("asset_id", "dim").agg(F.collect_set("tag").alias("ai"))
    h = human.groupBy("asset_id", "dim").agg(F.collect_set("tag").alias("human"))
    none = F.array().cast("array<string>")
    both = a.join(h, ["asset_id", "dim"], "full").select("asset_id", "dim", F.coalesce("ai", none).alias("ai"), F.coalesce("human", none).alias("human"))
    out = both.select(
        "asset_id", "dim", F.array_sort(F.array_except("ai", "human")).alias("only_ai"), F.array_sort(F.array_except("human", "ai")).alias("only_human"),
        F.array_sort(F.array_intersect("ai", "human")).alias("both"),
    )
    return out.where((F.size("only_ai") > 0) | (F.size("only_human") > 0))


def validated(tags: DataFrame, dim_values: DataFrame) -> DataFrame:
    """Adds ``valid``: tags of dimensions the ontology does not know are valid, others must be listed."""
    known = dim_values.select(F.col("dim").alias("_d")).distinct()
    listed = dim_values.select(F.col("dim").alias("_ld"), F.col("value").alias("_v")).distinct()
    joined = tags.join(known, F.col("dim") == F.col("_d"), "left").join(listed, (F.col("dim") == F.col("_ld")) & (F.col("tag") == F.col("_v")), "left")
    return joined.withColumn("valid", F.col("_d").isNull() | F.col("_v").isNotNull()).drop("_d", "_ld", "_v")


def canonical(tags: DataFrame, dim_aliases: DataFrame, value_aliases: DataFrame) -> DataFrame:
    """Dimension aliases, then value aliases within the dimension, by their official names."""
    d = dim_aliases.select(F.col("alias").alias("_a"), F.col("dim").alias("_dim"))
    named = tags.join(d, F.col("dim") == F.col("_a"), "left").withColumn("dim", F.coalesce("_dim", "dim")).drop("_a", "_dim")
    v = value_aliases.select(F.col("dim").alias("_vd"), F.col("alias").alias("_va"), F.col("value").alias("_vv"))
    return named.join(v, (F.col("dim") == F.col("_vd")) & (F.col("tag") == F.col("_va")), "left").withColumn("tag", F.coalesce("_vv", "tag")).drop("_vd", "_va", "_vv")


def candidates(tags: DataFrame, dim_values: DataFrame, value_aliases: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Tags in the data that are no value, no alias and not dismissed, with their counts."""
    out = tags.groupBy("dim", "tag").agg(F.count("*").alias("n"))
    for known, value in ((dim_values, "value"), (value_aliases, "alias"), (dismissed, "value")):
        out = out.join(known.select("dim", F.col(value).alias("tag")).distinct(), ["dim", "tag"], "left_anti")
    return out


def mapped_labels(labels: Column, mapping: dict[str, str]) -> Column:
    """Trimmed lower-case labels through a vocabulary map, unmapped dropped, distinct in order."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    named = F.transform(labels, lambda x: F.try_element_at(table, F.lower(F.trim(x))))
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def unsupported_events(events: DataFrame, objects: DataFrame, needs: DataFrame) -> DataFrame:
    """Adds ``unsupported`` to (asset_id, event): the event needs objects of which the asset has none."""
    wanted = needs.groupBy(F.col("event").alias("_e")).agg(F.collect_set("object").alias("_needs"))
    have = objects.groupBy(F.col("asset_id").alias("_id")).agg(F.collect_set("object").alias("_have"))
    joined = events.join(wanted, F.col("event") == F.col("_e"), "left").join(have, F.col("asset_id") == F.col("_id"), "left")
    fits = F.arrays_overlap("_needs", F.coalesce("_have", F.array().cast("array<string>")))
    return joined.withColumn("unsupported", F.col("_needs").isNotNull() & ~F.coalesce(fits, F.lit(False))).drop("_e", "_needs", "_id", "_have")


def tag_statistics(tags: DataFrame, keys: list[str]) -> DataFrame:
    """Totals and counts per source of tags by ``keys``."""
    return tags.groupBy(*keys).agg(F.count("*").alias("total"), F.countDistinct("tag").alias("n_names"), *[F.count_if(F.col("source") == s).alias(f"from_{s.lower()}") for s in ("AI", "Human", "Rule")])


def complemented(human: Column, model: Column, rejected: Column) -> Column:
    """Human tags and what the model adds, less the rejected."""
    none = F.array().cast("array<string>")
    return F.array_except(F.array_union(F.coalesce(human, none), F.coalesce(model, none)), F.coalesce(rejected, none))


def value_added(dim_values: DataFrame, value_aliases: DataFrame, dim: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The ontology with a value before ``unknown``; an alias of the same name goes.  ``dim_values``: dim, value, position."""
    own = (F.col("dim") == dim) & (F.col("value") == value)
    if dim_values.where(own).limit(1).count():
        return dim_values, value_aliases
    last = F.coalesce(F.min(F.when(F.col("value") == "unknown", F.col("position"))), F.max("position") + 1)
    place = dim_values.where(F.col("dim") == dim).agg(F.coalesce(last, F.lit(0)).alias("position"))
    moved = dim_values.crossJoin(F.broadcast(place.select(F.col("position").alias("_at")))).withColumn(
        "position", F.when((F.col("dim") == dim) & (F.col("position") >= F.col("_at")), F.col("position") + 1).otherwise(F.col("position"))
    ).drop("_at")
    new = place.select(F.lit(dim).alias("dim"), F.lit(value).alias("value"), "position")
    return moved.unionByName(new), value_aliases.where(~((F.col("dim") == dim) & (F.col("alias") == value)))


def alias_added(dim_values: DataFrame, value_aliases: DataFrame, dim: str, alias: str, value: str) -> DataFrame:
    """The aliases (dim, alias, value) with one more, or with its new target.  The target must be a value of the dimension, the alias must not be."""
    found = {r["value"] for r in dim_values.where((F.col("dim") == dim) & F.col("value").isin(alias, value)).select("value").collect()}
    if value not in found:
        raise ValueError(f"no such value of {dim}: {value}")
    if alias in found:
        raise ValueError(f"already a value of {dim}: {alias}")
    rest = value_aliases.where(~((F.col("dim") == dim) & (F.col("alias") == alias)))
    new = value_aliases.sparkSession.range(1).select(F.lit(dim).alias("dim"), F.lit(alias).alias("alias"), F.lit(value).alias("value"))
    return rest.select("dim", "alias", "value").unionByName(new)


def dismissed(given_up: DataFrame, dim: str, tag: str) -> DataFrame:
    """The given-up candidates (dim, tag) with one more; they are not offered again, while data that have them keep them."""
    new = given_up.sparkSession.range(1).select(F.lit(dim).alias("dim"), F.lit(tag).alias("tag"))
    return given_up.select("dim", "tag").unionByName(new).distinct()


def restored(given_up: DataFrame, dim: str, tag: str) -> DataFrame:
    """The given-up candidates without one, which is offered again."""
    return given_up.where(~((F.col("dim") == dim) & (F.col("tag") == tag)))
