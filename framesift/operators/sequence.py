"""Frame sequences: keys from file names, runs, windows, sampling and ranked picks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from framesift.functions.paths import basename, dirname, forward, slug, stem
from framesift.operators import blocks
from framesift.plans.order import with_position
from framesift.plans.shared import write_shared

#: File-name rules of ordered frames; their order decides.  Fixed values (patterns).
V_NAME = r"(?i)^(v\d+)_(\d+)_(\d+)\.jpg$"
MS_NAME = r"(?i)^(.+)_(\d{13})(_.*)?\.jpg$"
SECONDS_NAME = r"^(\d{9,})\.(\d{1,3})\.jpg$"
INDEX_NAME = r"^(.+?)(\d{3,})\.jpg$"

GAP_MS, INDEX_GAP, CLIP_FRAMES, MIN_FRAMES = 10_000, 2, 30, 5
#: A window of Spark sorts a key in one task; where a key has more rows than this, keys are scanned in blocks, with the same result.
RUN_ROWS = 2_000_000


def _part(name: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(name, pattern, group)


def _milliseconds(name: Column) -> Column:
    return _part(name, SECONDS_NAME, 1).try_cast("long") * 1000 + F.rpad(_part(name, SECONDS_NAME, 2), 3, "0").try_cast("long")


def seq_key(path: Column) -> Column:
    """struct(run_id, mode, value, sub) of an ordered frame's file name, or null.

    Modes: ``seq`` (value, then sub number the frames), ``ms`` (epoch milliseconds), ``idx`` (a running number).
    """
    p, name, folder = forward(path), basename(path), dirname(path)
    last_folder = F.substring_index(folder, "/", -1)
    bare = F.regexp_replace(name, r"(?i)\.jpg$", "")
    tail = F.when((last_folder != "") & F.startswith(bare, F.concat(last_folder, F.lit("_"))), F.substring(bare, F.length(last_folder) + 2, F.lit(1 << 20)))
    zero = F.lit(0).cast("long")

    def key(run_id: Column, mode: str, value: Column, sub: Column) -> Column:
        return F.struct(run_id.alias("run_id"), F.lit(mode).alias("mode"), value.alias("value"), sub.cast("long").alias("sub"))

    return (
        F.when(tail.rlike(r"^\d+$"), key(F.concat(F.lit("bucket:"), folder), "seq", zero, tail.try_cast("long")))
        .when(name.rlike(V_NAME), key(F.concat(F.lit("v:"), _part(name, V_NAME, 1)), "seq", _part(name, V_NAME, 2).try_cast("long"), _part(name, V_NAME, 3).try_cast("long")))
        .when(name.rlike(MS_NAME), key(F.concat_ws(":", F.lit("ms"), folder, _part(name, MS_NAME, 3)), "ms", _part(name, MS_NAME, 2).try_cast("long"), zero))
        .when(name.rlike(SECONDS_NAME), key(F.concat(F.lit("secms:"), folder), "ms", _milliseconds(name), zero))
        .when(name.rlike(INDEX_NAME), key(F.concat_ws(":", F.lit("idx"), folder, _part(name, INDEX_NAME, 1)), "idx", _part(name, INDEX_NAME, 2).try_cast("long"), zero))
        .when(p.isNull(), F.lit(None))
    )


def with_seq_key(frames: DataFrame, path: str = "path", name: str = "_k") -> DataFrame:
    """Ordered frames with their ``seq_key``.  The key comes out of a generator, so its rules are evaluated once a row and not once for every field
    and filter that reads it."""
    return frames.withColumn(name, F.explode(F.array(seq_key(F.col(path))))).where(F.col(name).isNotNull())


def frame_ms(path: Column) -> Column:
    """Milliseconds in a frame's file name (three shapes), or null."""
    name = basename(path)
    return (
        F.when(name.rlike(SECONDS_NAME), _milliseconds(name))
        .when(name.rlike(V_NAME), _part(name, V_NAME, 2).try_cast("long"))
        .when(name.rlike(MS_NAME), _part(name, MS_NAME, 2).try_cast("long"))
    )


def has_hot_key(rows: DataFrame, keys: list[str], run_rows: int) -> bool:
    """Whether any key has more than ``run_rows`` rows: counts are combined before the shuffle, one number reaches the driver."""
    return (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > run_rows


def with_cuts(rows: DataFrame, run: list[str], order: list[str], read: list[str], cut, run_rows: int) -> DataFrame:
    """Adds ``run_no``, the cuts up to a row; ``cut`` tells from accessors of this row's and the last row's columns."""
    if has_hot_key(rows, run, run_rows):
        return blocks.cumulative_cuts(rows, run, order, read, cut, "run_no")
    own = W.partitionBy(*run).orderBy(*order)
    marked = rows.withColumn("_cut", F.coalesce(cut(F.col, lambda c: F.lag(c).over(own)).cast("long"), F.lit(0).cast("long")))
    return marked.withColumn("run_no", F.sum("_cut").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def split_runs(rows: DataFrame, run: list[str], value: str, tie: list[str], mode: str = "ms", sub: str | None = None, gap_ms: int = GAP_MS, index_gap: int = INDEX_GAP, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds ``run_no``, from 0 within each key: a run ends where the gap rule of ``mode`` cuts.

    Ties in ``value`` keep the order of ``tie``.
    """
    if mode == "seq":
        return with_cuts(rows, run, [value, *tie], [sub], lambda now, before: now(sub) <= before(sub), run_rows)
    return with_cuts(rows, run, [value, *tie], [value], lambda now, before: now(value) - before(value) > (gap_ms if mode == "ms" else index_gap), run_rows)


def split_keyed_runs(rows: DataFrame, position: str = "position", gap_ms: int = GAP_MS, index_gap: int = INDEX_GAP, run_rows: int = RUN_ROWS) -> DataFrame:
    """``run_no`` for rows with seq_key fields run_id, mode, value and sub, each mode by its own rule."""

    def cut(now, before):
        step = now("value") - before("value")
        return F.when(now("mode") == "seq", now("sub") <= before("sub")).when(now("mode") == "ms", step > gap_ms).otherwise(step > index_gap)

    return with_cuts(rows, ["run_id", "mode"], ["value", "sub", position], ["value", "sub", "mode"], cut, run_rows)


def fixed_windows(rows: DataFrame, run: list[str], order: list[str], size: int = CLIP_FRAMES, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds ``window_no``: every ``size`` rows of a run, the last window short."""
    if has_hot_key(rows, run, run_rows):
        return blocks.placed(rows, run, order, "_at").withColumn("window_no", F.floor(F.col("_at") / size).cast("long")).drop("_at")
    number = F.row_number().over(W.partitionBy(*run).orderBy(*order)) - 1
    return rows.withColumn("window_no", F.floor(number / size).cast("long"))


def with_group(rows: DataFrame, keys: list[str], facts: dict[str, Column], run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds aggregates of a row's group: over a window, or, where a group is hot, grouped and joined, which adaptive execution can split."""
    if not has_hot_key(rows, keys, run_rows):
        own = W.partitionBy(*keys)
        return rows.withColumns({name: fact.over(own) for name, fact in facts.items()})
    kept = write_shared(rows, "grouped-rows")
    grouped = kept.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*[fact.alias(name) for name, fact in facts.items()])
    return kept.join(grouped, blocks.same(keys)).select(*rows.columns, *facts)


def _number_windows(batches: Iterator[pa.RecordBatch], ms: str, span: float, floor_frames: int, min_tail: int, size: int) -> Iterator[pa.RecordBatch]:
    """``window_no`` for rows sorted by run and time, with ``_at`` (place in the run) and ``_timed``.

    Of the open window only number, first time and size are kept, and its rows while they are fewer than ``min_tail``.
    """
    held, no, began, count = None, 0, 0, min_tail

    def numbered(part: pa.Table, window: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = part.drop_columns(["_at", "_timed"]).append_column("window_no", pa.array(window, pa.int64()))
        yield from kept.filter(pa.array(window >= 0)).to_batches()

    for batch in batches:
        part = pa.Table.from_batches([batch])
        old = held.num_rows if held is not None else 0
        if old:
            part = pa.concat_tables([held, part])
        n = part.num_rows
        at, timed = part["_at"].to_numpy(), part["_timed"].to_numpy()
        times = pc.fill_null(part[ms], 0).to_numpy()
        window = np.full(n, no, np.int64)
        edges = [old, *(np.flatnonzero(at[old:] == 0) + old), n]
        for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
            if k:  # a run begins, so the one before has its last window
                if count < min_tail:
                    window[low - count : low] = no - 1
                no, count = 0, 0
            if low < high and not timed[low]:
                window[low:high], count = at[low:high] // size, min_tail
                continue
            while low < high:
                began = times[low] if not count else began
                may_close = low + max(floor_frames - count, 0 if count else 1)
                late = np.flatnonzero(times[may_close:high] - began >= span)
                end = may_close + late[0] if len(late) else high
                window[low:end] = no
                count += end - low
                if end < high:
                    no, count = no + 1, 0
                low = end
        ready = n - (count if count < min_tail else 0)
        held = part.slice(ready)
        yield from numbered(part.slice(0, ready), window[:ready])
    if held is not None and held.num_rows:
        yield from numbered(held, np.full(held.num_rows, no - 1))


def clip_windows(rows: DataFrame, run: list[str], order: list[str], ms: str, seconds: float, size: int = CLIP_FRAMES, min_tail: int = MIN_FRAMES, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds ``window_no`` to the rows of each run in their order; no run is held in memory.

    Where ``seconds`` is positive, a window closes before the first frame that comes when it has ``size`` frames and
    ``seconds``; a tail shorter than ``min_tail`` joins the window before it, or is dropped where there is none.  Runs in
    which a time (``ms``, milliseconds) is missing or first and last are equal, and all runs without ``seconds``, have
    windows of every ``size`` frames.
    """
    if seconds <= 0:
        return fixed_windows(rows, run, order, size, run_rows)
    if has_hot_key(rows, run, run_rows):
        one_by_one = lambda some: clip_windows(some, run, order, ms, seconds, size, min_tail, sys.maxsize)
        return blocks.timed_windows(rows, run, order, ms, seconds * 1000, size, min_tail, one_by_one)
    own = W.partitionBy(*run).orderBy(*order)
    placed = rows.withColumn("_at", (F.row_number().over(own) - 1).cast("long"))
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    usable = (F.count(ms).over(whole) == F.count(F.lit(1)).over(whole)) & (F.first(ms).over(whole) != F.last(ms).over(whole))
    schema = T.StructType([*rows.schema.fields, T.StructField("window_no", T.LongType())])
    # the windows above leave the rows clustered by run and sorted, and the stream keeps that order
    marked = placed.withColumn("_timed", F.coalesce(usable, F.lit(False)))
    return marked.mapInArrow(lambda batches: _number_windows(batches, ms, seconds * 1000, size, min_tail, size), schema)


def clip_seconds(rows: DataFrame, config: DataFrame, project: str = "project") -> DataFrame:
    """Adds ``clip_seconds`` from (scope, seconds): the project's own, else that of ``*``, else 0."""
    own = config.where("scope <> '*'").select(F.col("scope").alias("_scope"), F.col("seconds").alias("_own"))
    every = F.broadcast(config.where("scope = '*'").agg(F.max("seconds").alias("_every")))
    joined = rows.join(own, F.col(project) == F.col("_scope"), "left").crossJoin(every)
    return joined.withColumn("clip_seconds", F.coalesce("_own", "_every", F.lit(0.0))).drop("_scope", "_own", "_every")


def build_seq_clips(frames: DataFrame, size: int = CLIP_FRAMES, min_frames: int = MIN_FRAMES, seconds: float = 0.0, run_rows: int = RUN_ROWS) -> DataFrame:
    """Clips of frames (id, path, position) ordered by their file names: runs of at least ``min_frames``, cut by
    ``clip_windows`` with the times that the names tell.

    ``legacy_clip_id`` is made of the last 48 characters of the first path, which can collide; ``clip_id``
    adds a hash of the run.
    """
    run, order = ["run_id", "mode", "run_no"], ["value", "sub", "position", "id"]
    keyed = with_seq_key(frames).select("id", "path", "position", frame_ms(F.col("path")).alias("ms"), "_k.*")
    facts = {"_n": F.count(F.lit(1)), "head": F.min_by("path", F.struct(*order))}
    sized = with_group(split_keyed_runs(keyed, run_rows=run_rows), run, facts, run_rows)
    cut = clip_windows(sized.where(F.col("_n") >= min_frames).drop("_n", "path"), run, order, "ms", seconds, size, min_frames, run_rows)
    items = F.array_sort(F.collect_list(F.struct(*order)))
    clips = cut.groupBy(*run, "head", F.col("window_no").cast("int").alias("clip_index")).agg(F.transform(items, lambda f: f["id"]).alias("frame_ids"))
    legacy = F.format_string("seq_%s_%05d", slug(F.col("head")), F.col("clip_index"))
    folder = F.when(dirname(F.col("head")) == "", F.lit("images")).otherwise(dirname(F.col("head")))
    return clips.select(
        F.concat_ws("_", legacy, F.substring(F.md5(F.concat_ws("|", "run_id", "mode", F.col("run_no").cast("string"))), 1, 8)).alias("clip_id"),
        legacy.alias("legacy_clip_id"), F.concat(F.lit("seq:"), folder).alias("video_id"), "clip_index", "frame_ids",
    )


def build_video_clips(frames: DataFrame, size: int = CLIP_FRAMES, min_frames: int = MIN_FRAMES, seconds: float = 0.0, run_rows: int = RUN_ROWS) -> DataFrame:
    """Clips of frames (id, video_path, timestamp in seconds, frame_index) with a video, ordered by time, then index."""
    order = ["t", "i", "id"]
    timed = frames.where("video_path IS NOT NULL").select("video_path", F.coalesce("timestamp", F.lit(0.0)).alias("t"), F.coalesce("frame_index", F.lit(0)).alias("i"), "id")
    cut = clip_windows(timed.withColumn("ms", (F.col("t") * 1000).cast("long")), ["video_path"], order, "ms", seconds, size, min_frames, run_rows)
    items = F.array_sort(F.collect_list(F.struct(*order)))
    clips = cut.groupBy("video_path", F.col("window_no").cast("int").alias("clip_index")).agg(F.transform(items, lambda f: f["id"]).alias("frame_ids"))
    return clips.select(F.format_string("%s_%05d", stem(F.col("video_path")), F.col("clip_index")).alias("clip_id"), F.col("video_path").alias("video_id"), "clip_index", "frame_ids")


#: What a clip that is built again keeps of its judgement.
RESULTS = ["vlm_result", "human_tags", "final_tags", "human_rejected", "decision"]


def rebuild_clips(frames: DataFrame, old: DataFrame, size: int = CLIP_FRAMES, min_frames: int = MIN_FRAMES, seconds: float = 0.0, fields: list[str] | None = None, run_rows: int = RUN_ROWS) -> DataFrame:
    """All clips of frames (id, path, position, video_path, timestamp, frame_index): those of videos by their times, the other frames' by the order their names
    tell, each with the results of the old clip of the same id where its frames are the same."""
    columns = ["clip_id", "video_id", "clip_index", "frame_ids"]
    videos = build_video_clips(frames, size, min_frames, seconds, run_rows).select(columns)
    sequences = build_seq_clips(frames.where("video_path IS NULL").select("id", "path", "position"), size, min_frames, seconds, run_rows).select(columns)
    return inherit_results(videos.unionByName(sequences), old, RESULTS if fields is None else fields)


def inherit_results(clips: DataFrame, old: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``fields`` of the old clip with the same clip_id, only where its frame ids are the same list."""
    before = old.select(F.col("clip_id").alias("_id"), F.col("frame_ids").alias("_frames"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    joined = clips.join(before, F.col("clip_id") == F.col("_id"), "left")
    same = F.col("frame_ids").eqNullSafe(F.col("_frames"))
    return joined.select(*[clips[c] for c in clips.columns], *[F.when(same, F.col(f"_old_{f}")).alias(f) for f in fields])


def evenly_spaced(items: Column, count: int) -> Column:
    """At most ``count`` items at even distances, first and last included, halves rounded to even."""
    n = F.size(items)
    picks = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * (n - 1) / max(count - 1, 1), 0).cast("int"))
    chosen = F.transform(F.array_distinct(picks), lambda i: F.get(items, i))
    if count <= 0:
        return F.slice(items, 1, 0)
    return F.when(n <= count, items).when(F.lit(count == 1), F.slice(items, 1, 1)).otherwise(chosen)


def evenly_spaced_rows(rows: DataFrame, key: str, item: str, count: int) -> DataFrame:
    """(key, picks) as ``evenly_spaced`` of each key's items in order, for ``count`` of 2 or more; only picked items are collected."""
    own = W.partitionBy(key)
    placed = rows.withColumn("_at", F.row_number().over(own.orderBy(F.asc_nulls_last(item))) - 1).withColumn("_n", F.count(item).over(own))
    picks = F.array(*[F.bround(F.lit(i) * (F.col("_n") - 1) / (count - 1), 0).cast("int") for i in range(count)])
    chosen = placed.where((F.col("_n") <= count) | F.array_contains(picks, F.col("_at")))
    return chosen.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("picks"))


def ranked(rows: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return ranked(rows, keys, order, "_rank").where("_rank = 1").drop("_rank")


def capped(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of a key; all of them where ``most`` is not positive."""
    return rows if most <= 0 else ranked(rows, keys, order, "_rank").where(F.col("_rank") <= most).drop("_rank")


def sampled(rows: DataFrame, keys: list[str], id_column: str, most: int, seed: int = 42) -> DataFrame:
    """``most`` rows of each key, chosen by a hash of seed and id, so the same on every run."""
    return capped(rows, keys, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))), F.col(id_column)], most)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, by one grouped maximum, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def systematic(rows: DataFrame, order: list[str], number: int) -> DataFrame:
    """About ``number`` rows at equal distances of the order (every count // number-th)."""
    placed = with_position(rows, order)
    total = placed.count()
    step = max(1, total // max(1, number))
    return placed.where((F.col("position") % step == 0) & (F.col("position") < step * number)).drop("position")
