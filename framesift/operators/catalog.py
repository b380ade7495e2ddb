"""Catalog maintenance on plain tables: joins by key, upserts, deletes and state folds.

Every operator returns the new table (or the rows to append); writing it is the caller's choice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framesift.functions.paths import basename
from framesift.operators.sequence import first_per_key


def missing_rows(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not in the table."""
    return new.join(existing.select(*keys), keys, "left_anti")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The table with the first new row of each absent key; a null key never matches and is inserted."""
    return existing.unionByName(first_per_key(missing_rows(new, existing, keys), keys, order).select(*existing.columns))


def attach_sources(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_id by basename of the path (the first source of a name); null where there is none."""
    named = first_per_key(sources.withColumn("_b", basename(F.col("relative_path"))), ["_b"], ["source_id"]).select("_b", F.col("source_id").alias("found_source"))
    return assets.withColumn("_n", basename(F.col("video_path"))).join(named, F.col("_n") == F.col("_b"), "left").drop("_n", "_b")


def first_match(batch: DataFrame, metadata: DataFrame) -> DataFrame:
    """The first metadata row (by position) for each path of the batch, matched by basename."""
    firsts = first_per_key(metadata.withColumn("_b", basename(F.col("path"))), ["_b"], ["position"])
    return batch.withColumn("_n", basename(F.col("path"))).select("_n", F.col("path").alias("batch_path")).join(firsts, F.col("_n") == F.col("_b")).drop("_n", "_b")


def realigned(catalog: DataFrame, order: DataFrame) -> DataFrame:
    """The catalog with vector ids from a new order (path, position): moved where different, gone where missing.

    Adds ``moved``; both sides are joined by basename, of which the first position counts.
    """
    new = order.groupBy(basename(F.col("path")).alias("_b")).agg(F.min("position").alias("_new"))
    joined = catalog.withColumn("_n", basename(F.col("path"))).join(new, F.col("_n") == F.col("_b"))
    return joined.withColumn("moved", ~F.col("_new").eqNullSafe(F.col("vector_id"))).withColumn("vector_id", F.col("_new")).drop("_n", "_b", "_new")


def suffix_match(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Paths that equal a name or end with "/name" (names without folders): an equi-join on the basename."""
    return paths.withColumn("_b", basename(F.col("path"))).join(names.select(F.col("name").alias("_b")).distinct(), "_b", "left_semi").drop("_b")


def lookup_cascade(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The stored file of each manifest row: same path, else same name, else the first name that ends with _name.

    ``wanted``: row, file_path, filename; ``files``: path, name.  The third way joins on name suffixes after each _.
    """
    by_path = files.select(F.col("path").alias("p1")).distinct()
    by_name = files.groupBy(F.col("name").alias("n2")).agg(F.min("path").alias("p2"))
    parts = F.split("name", "_")
    tails = files.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))).alias("tail"))
    by_tail = tails.where("tail <> ''").groupBy(F.col("tail").alias("n3")).agg(F.min("path").alias("p3"))
    joined = wanted.join(by_path, F.col("file_path") == F.col("p1"), "left").join(by_name, F.col("filename") == F.col("n2"), "left").join(by_tail, F.col("filename") == F.col("n3"), "left")
    way = F.when(F.col("p1").isNotNull(), "path").when(F.col("p2").isNotNull(), "name").when(F.col("p3").isNotNull(), "suffix").otherwise("missing")
    return joined.select("row", F.coalesce("p1", "p2", "p3").alias("path"), way.alias("way"))


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_anti")


def cleared_except(clips: DataFrame, keep: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields set to null on every row whose key is not kept; an empty keep list is refused."""
    if not keep.limit(1).count():
        raise ValueError("an empty keep list would clear everything")
    kept = keep.select(F.col(key).alias("_k")).distinct()
    joined = clips.join(kept, F.col(key) == F.col("_k"), "left")
    return joined.select(*[F.when(F.col("_k").isNotNull(), F.col(c)).alias(c) if c in fields else F.col(c) for c in clips.columns])


def clear_counts(clips: DataFrame, keep: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What ``cleared_except`` would do: rows with any of the fields before, those to be cleared and those left."""
    kept = keep.select(F.col(key).alias("_k")).distinct()
    held = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])
    joined = clips.where(held).join(kept, F.col(key) == F.col("_k"), "left")
    return joined.agg(F.count("*").alias("had"), F.count_if(F.col("_k").isNull()).alias("cleared"), F.count("_k").alias("kept"))


def without_siblings(folders: DataFrame, column: str = "dir", tokens: list[tuple[str, str]] = (("8M", "2M"), ("8m", "2m"))) -> DataFrame:
    """Folders less those whose low-resolution sibling (the first token pair in the path, replaced once) is there too."""
    sibling = F.lit(None).cast("string")
    for a, b in reversed(tokens):
        sibling = F.when(F.contains(column, F.lit(a)), F.regexp_replace(F.col(column), f"^(.*?){a}", f"$1{b}")).otherwise(sibling)
    marked = folders.withColumn("_s", sibling)
    have = folders.select(F.col(column).alias("_h")).distinct()
    twice = marked.join(have, F.col("_s") == F.col("_h"), "left_semi").select(column)
    return folders.join(twice.distinct(), column, "left_anti")


def less_dense(folders: DataFrame, jobs: DataFrame, step: int) -> DataFrame:
    """Folders that no earlier job covered with a smaller step; jobs match on the last two path segments, default step 999."""
    def tail(c: Column) -> Column:
        return F.substring_index(F.regexp_replace(c, r"\\", "/"), "/", -2)

    denser = jobs.where(F.coalesce("step", F.lit(999)) < step).select(tail(F.col("dir")).alias("_t")).distinct()
    return folders.withColumn("_d", tail(F.col("dir"))).join(denser, F.col("_d") == F.col("_t"), "left_anti").drop("_d")


def upserted(existing: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of both; ``columns`` come from the new row where it has a value, all else stays as it is."""
    n = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in existing.columns if c not in keys])
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    joined = existing.withColumn("_old", F.lit(True)).join(n, same, "full")
    old = F.coalesce(F.col("_old"), F.lit(False))
    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"_k_{c}")).alias(c)
        if c in columns:
            return F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c)
        return F.when(old, F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c)
    return joined.select(*[value(c) for c in existing.columns])


def latest_wins(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keyed cache upsert: of old and new rows of a key the one with the greatest version."""
    both = existing.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def job_state(events: DataFrame) -> DataFrame:
    """Folds job events (job_id, at, status, progress, error): the last given value of each field, started_at of the first
    RUNNING, completed_at of the last terminal status (null while the job is in another)."""
    terminal = F.col("status").isin("COMPLETED", "FAILED", "CANCELLED")
    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    folded = events.groupBy("job_id").agg(
        last("status").alias("status"), last("progress").alias("progress"), last("error").alias("error"),
        F.min(F.when(F.col("status") == "RUNNING", F.col("at"))).alias("started_at"), F.max(F.when(terminal, F.col("at"))).alias("_done"),
    )
    return folded.withColumn("completed_at", F.when(terminal, F.col("_done"))).drop("_done")


def activated(models: DataFrame, name: str, version: str) -> DataFrame:
    """At most one active version of ``name``; an unknown version leaves none."""
    return models.withColumn("is_active", F.when(F.col("name") == name, F.col("version") == version).otherwise(F.col("is_active")))


def deleted(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame) -> dict[str, DataFrame]:
    """Each child table without the rows of the keys; a table names its own key column (integer or string)."""
    return {name: t.join(keys.select(F.col("key").alias(c)).distinct(), c, "left_anti") for name, (t, c) in tables.items()}


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def judged(clips: DataFrame, judgements: DataFrame) -> DataFrame:
    """Batch write-back: the last judgement (by ``at``) of a clip; its decision only where given."""
    last = judgements.groupBy(F.col("clip_id").alias("_c")).agg(F.max_by(F.struct("result", "decision"), F.struct("at", "result")).alias("_j"))
    joined = clips.join(last, F.col("clip_id") == F.col("_c"), "left")
    return joined.withColumn("vlm_result", F.coalesce("_j.result", "vlm_result")).withColumn("decision", F.coalesce("_j.decision", "decision")).drop("_c", "_j")


def error_fold(errors: DataFrame, clips: DataFrame, limit: int = 3) -> DataFrame:
    """Adds n_errors and last_error; REVIEW where a clip without a result failed ``limit`` times."""
    n = errors.groupBy(F.col("clip_id").alias("_c")).agg(F.count("*").alias("_n"), F.max_by("message", "at").alias("last_error"))
    joined = clips.join(n, F.col("clip_id") == F.col("_c"), "left").withColumn("n_errors", F.coalesce("_n", F.lit(0)))
    stuck = (F.col("n_errors") >= limit) & F.col("vlm_result").isNull()
    return joined.withColumn("decision", F.when(stuck, F.lit("REVIEW")).otherwise(F.col("decision"))).drop("_c", "_n")


def resume_point(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first position at which two ordered lists (position, path) differ, or the shorter one's length."""
    o, n = old.select("position", F.col("path").alias("a")), new.select("position", F.col("path").alias("b"))
    joined = o.join(n, "position", "full")
    return joined.agg(F.coalesce(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("position"))), F.count("*")).alias("resume_at"))


def padded(catalog: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Each row's embedding, zeros where there is none."""
    v = vectors.select(F.col("vector_id").alias("_v"), "embedding")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return catalog.join(v, F.col("vector_id") == F.col("_v"), "left").withColumn("embedding", F.coalesce("embedding", zero)).drop("_v")


def expanded_work(clips: DataFrame) -> DataFrame:
    """(frame_id, place): frames of an ordered clip list (position, frame_ids), each at its first place."""
    each = clips.select("position", F.posexplode("frame_ids").alias("at", "frame_id"))
    return each.groupBy("frame_id").agg(F.min(F.struct("position", "at")).alias("place"))


def migrated(legacy: DataFrame, store: DataFrame) -> DataFrame:
    """{project: {fid: record}} maps as rows that the store does not have yet."""
    rows = legacy.select(F.explode("projects").alias("project", "records")).select("project", F.explode("records").alias("fid", "rec"))
    return missing_rows(rows.dropDuplicates(["project", "fid"]), store, ["project", "fid"])


def new_id(text: Column | None = None) -> Column:
    """A 16-character id: of the given text, so that a repeated task gives it again, or random."""
    return F.substring(F.md5(text.cast("binary")) if text is not None else F.regexp_replace(F.uuid(), "-", ""), 1, 16)


def copy_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source files whose basename the target lacks."""
    have = target.select(basename(F.col("path")).alias("_b")).distinct()
    return source.withColumn("_b", basename(F.col("path"))).join(have, "_b", "left_anti").drop("_b")


def stepped(assets: DataFrame, updates: DataFrame) -> DataFrame:
    """Column updates (id, vector_id, detections, final_tags, decision; null: not given) with the status they lead to.

    A vector makes EMBEDDED, detections DETECTED, final tags TAGGED, and a decision its own state (an unknown one REVIEW);
    the furthest given step decides.
    """
    from framesift.operators.decision import state_after

    u = updates.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("vector_id", "detections", "final_tags", "decision")])
    joined = assets.join(u, F.col("id") == F.col("_id"), "left")
    status = (
        F.when(F.col("_decision").isNotNull(), state_after(F.col("_decision"))).when(F.col("_final_tags").isNotNull(), F.lit("TAGGED"))
        .when(F.col("_detections").isNotNull(), F.lit("DETECTED")).when(F.col("_vector_id").isNotNull(), F.lit("EMBEDDED")).otherwise(F.col("status"))
    )
    values = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("vector_id", "detections", "final_tags", "decision")}
    return joined.select(*[values[c].alias(c) if c in values else status.alias(c) if c == "status" else F.col(c) for c in assets.columns])


def synced(existing: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows to append for metadata records whose vector id the catalog lacks, with defaults filled in.

    ``records``: id, path, filename, frame_index, timestamp, video_path, src_dir as text where read from JSON.
    """
    new = records.withColumn("vector_id", F.col("id").cast("string").try_cast("long")).where("vector_id IS NOT NULL").drop("id")
    new = missing_rows(first_per_key(new, ["vector_id"], ["path"]), existing, ["vector_id"])
    clean = new.select(
        "vector_id", "path", F.coalesce(F.nullif("filename", F.lit("")), basename(F.col("path"))).alias("filename"), F.coalesce(F.col("frame_index").cast("string").try_cast("int"), F.lit(0)).alias("frame_index"),
        F.coalesce(F.col("timestamp").cast("string").try_cast("double"), F.lit(0.0)).alias("timestamp"), F.coalesce("video_path", "path").alias("video_path"),
        F.when(F.col("src_dir").rlike(r"^(/|[A-Za-z]:)"), F.col("src_dir")).alias("source_root"),
    )
    return attach_sources(clean, sources)


def backfill_report(existing: DataFrame, records: DataFrame) -> DataFrame:
    """The dry run of a backfill: metadata records, rows before, rows to add and the gap that stays (records without a usable id)."""
    ids = records.select(F.col("id").cast("string").try_cast("long").alias("vector_id"))
    usable = ids.where("vector_id IS NOT NULL").distinct()
    counts = records.agg(F.count("*").alias("meta"))
    for name, rows in (("before", existing), ("added", missing_rows(usable, existing, ["vector_id"])), ("usable", usable)):
        counts = counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))
    return counts.select("meta", "before", "added", (F.col("meta") - F.col("usable")).alias("gap"))


def renamed(projects: DataFrame, project_id: int, name: str) -> DataFrame:
    """A new display name, unless another project shows the same."""
    shown = F.coalesce("display_name", "name")
    if projects.where((shown == name) & (F.col("id") != project_id)).limit(1).count():
        raise ValueError(f"another project is called {name}")
    return projects.withColumn("display_name", F.when(F.col("id") == project_id, F.lit(name)).otherwise(F.col("display_name")))


def human_labelled(clips: DataFrame, labels: DataFrame) -> DataFrame:
    """Human labels of clips: human, rejected, final (a copy of human where not given) and decision where given."""
    new = labels.select(F.col("clip_id").alias("_c"), *[F.col(c).alias(f"_{c}") for c in ("human_tags", "human_rejected", "final_tags", "decision")])
    joined = clips.join(new, F.col("clip_id") == F.col("_c"), "left")
    given = F.col("_c").isNotNull()
    values = {
        "human_tags": F.when(given, F.col("_human_tags")).otherwise(F.col("human_tags")),
        "human_rejected": F.when(given, F.coalesce("_human_rejected", "human_rejected")).otherwise(F.col("human_rejected")),
        "final_tags": F.when(given, F.coalesce("_final_tags", "_human_tags")).otherwise(F.col("final_tags")),
        "decision": F.coalesce("_decision", "decision"),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in clips.columns])


def appended(table: DataFrame, rows: DataFrame, key: str, seed: list[str]) -> DataFrame:
    """The table with new rows under ids made of their own values."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in seed])
    return table.unionByName(rows.withColumn(key, new_id(text)).select(*table.columns))


def round_summary(outcomes: DataFrame, root: str = "root") -> DataFrame:
    """Files found, new and submitted of an ingest round, per root and in all (root null)."""
    return outcomes.rollup(root).agg(F.count("*").alias("found"), F.count_if(F.col("outcome") != "known").alias("new"), F.count_if(F.col("outcome") == "submit").alias("submitted"))


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with a label of the same folder and stem, and nothing else."""
    return images.join(labels.select("folder", "stem").distinct(), ["folder", "stem"], "left_semi")


def capped_total(positives: DataFrame, order: list[str], most: int) -> DataFrame:
    return positives.orderBy(*order).limit(most)
