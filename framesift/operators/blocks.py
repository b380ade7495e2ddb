"""Scans along ordered keys in blocks, so that one hot key is spread over all tasks.

Rows are dealt by ranges of (key, order), each range a sorted block of a written table.  What a block needs to know of those before it is a summary
of a row for each key in a block: how many rows and cuts, the first and the last value, the state of the window that is open.  Summaries are
combined along a key, blocks in order, and each block then numbers its own rows.  Only the summaries of a key meet in
one task; the rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framesift.plans.shared import write_shared

Of = Callable[[str], Column]


def same(keys: list[str], left: str = "", right: str = "_k_") -> Column:
    """Equal keys, nulls included; the right side's names have a prefix."""
    return reduce(lambda a, b: a & b, (F.col(left + k).eqNullSafe(F.col(right + k)) for k in keys))


def in_blocks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_block`` and ``_in``: their range of (keys, order), and their place in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    written = write_shared(ranged, "blocks")  # the upper bits of the number name the task, the lower 33 count its rows
    return written.withColumn("_block", F.shiftright("_place", 33)).withColumn("_in", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")


def _segments(blocked: DataFrame, keys: list[str]) -> W:
    return W.partitionBy("_block", *keys).orderBy("_in")


def cumulative_cuts(rows: DataFrame, keys: list[str], order: list[str], read: list[str], cut: Callable[[Of, Of], Column], name: str) -> DataFrame:
    """Adds ``name``, how many cuts there are in a key up to a row; ``cut(now, before)`` tells from the columns ``read`` of a row and the row before
    whether there is one between them."""
    blocked = in_blocks(rows, keys, order)
    own = _segments(blocked, keys)

    def whether(now: Of, before: Of) -> Column:
        return F.coalesce(cut(now, before).cast("long"), F.lit(0).cast("long"))

    marked = blocked.withColumn("_cut", whether(F.col, lambda c: F.lag(c).over(own)))
    marked = write_shared(marked.withColumn("_cuts", F.sum("_cut").over(own.rowsBetween(W.unboundedPreceding, 0))).drop("_cut"), "cuts")
    edges = [f(c, "_in").alias(f"_{e}_{c}") for c in read for e, f in (("first", F.min_by), ("last", F.max_by))]
    summary = marked.groupBy(F.col("_block").alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("_cuts").alias("_all"), *edges)
    along = W.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_b")
    summary = summary.withColumn("_edge", whether(lambda c: F.col(f"_first_{c}"), lambda c: F.lag(f"_last_{c}").over(along)))
    before = F.sum(F.col("_edge") + F.col("_all")).over(along) - F.col("_all")
    offsets = summary.select("_b", *[f"_k_{k}" for k in keys], before.alias("_before"))
    joined = marked.join(offsets, (F.col("_block") == F.col("_b")) & same(keys))
    return joined.select(*rows.columns, (F.col("_cuts") + F.col("_before")).alias(name))


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the 0-based place of a row in its key."""
    blocked = in_blocks(rows, keys, order)
    summary = blocked.groupBy(F.col("_block").alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_first"))
    along = W.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_b")
    offsets = summary.withColumn("_shift", F.sum("_n").over(along) - F.col("_n") - F.col("_first"))
    joined = blocked.join(offsets, (F.col("_block") == F.col("_b")) & same(keys))
    return joined.select(*rows.columns, (F.col("_in") + F.col("_shift")).alias(name))


def _segment_facts(blocked: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """A written row for each key in a block: ``_seg`` and ``_run`` name the two, ``_shift`` leads from ``_in`` to the place in the key, ``_timed``
    tells whether the key's times can cut windows and ``_rising`` whether they never fall."""
    falls = F.lag(ms).over(_segments(blocked, keys)) > F.col(ms)
    per = blocked.withColumn("_falls", F.coalesce(falls, F.lit(False))).groupBy(F.col("_block").alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), F.count(ms).alias("_n_ms"), F.min("_in").alias("_first"), F.min_by(ms, "_in").alias("_first_ms"), F.max_by(ms, "_in").alias("_last_ms"), F.max("_falls").alias("_falls"),
    )
    key = [f"_k_{k}" for k in keys]
    along, whole = W.partitionBy(*key).orderBy("_b"), W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    fell = F.col("_falls") | F.coalesce(F.lag("_last_ms").over(along) > F.col("_first_ms"), F.lit(False))
    told = per.withColumns({"_seg": F.monotonically_increasing_id(), "_fell": fell})
    timed = (F.sum("_n_ms").over(whole) == F.sum("_n").over(whole)) & (F.first("_first_ms").over(whole) != F.last("_last_ms").over(whole))
    return write_shared(told.select(
        "_seg", F.min("_seg").over(whole).alias("_run"), "_b", *key, (F.sum("_n").over(along) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("_total"),
        F.coalesce(timed, F.lit(False)).alias("_timed"), (~F.max("_fell").over(whole)).alias("_rising"),
    ), "segments")


ENTRIES = T.StructType([T.StructField(c, T.LongType()) for c in ("_run", "_seg", "at", "ms", "last", "last_ms", "windows")])
STATES = T.StructType([T.StructField(c, T.LongType()) for c in ("_of", "_start", "_began", "_no", "_end", "_end_no")])


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Whole segments of batches sorted by segment: (segment, its columns)."""
    held, parts = None, []
    for batch in batches:
        columns = _columns(batch, width)
        seg = columns[0]
        cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True]) if len(seg) else []
        for low, high in zip(cuts, cuts[1:], strict=False):
            if seg[low] != held:
                if parts:
                    yield held, [np.concatenate(c) for c in zip(*parts, strict=True)]
                held, parts = seg[low], []
            parts.append([c[low:high] for c in columns])
    if parts:
        yield held, [np.concatenate(c) for c in zip(*parts, strict=True)]


def _entries(span: float, size: int):
    """For rows (_seg, _run, at, ms): where a window may open first in a segment, and in what state it then leaves it.

    A window that is open before the segment closes in it by the time a window from its first row would, so only rows up to there can be the first
    to open one.  ``last`` is the last window that opens in the segment from there on, ``windows`` how many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(ENTRIES)
        for seg, (_, owner, at, ms) in _pieces(batches, 4):
            n = len(at)
            after = np.minimum(n, np.maximum(np.arange(n) + size, np.searchsorted(ms, ms + span, "left")))
            last, windows = list(range(n)), [1] * n
            for i, j in zip(range(n - 1, -1, -1), after[::-1].tolist(), strict=True):
                if j < n:
                    last[i], windows[i] = last[j], windows[j] + 1
            open_ = 1 if at[0] == 0 else min(n, int(after[0]) + 1)
            end = np.array(last[:open_])
            columns = [np.full(open_, owner[0]), np.full(open_, seg), at[:open_], ms[:open_].astype(np.int64), at[end], ms[end].astype(np.int64), np.array(windows[:open_], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def _states(span: float, size: int):
    """Follows the entries of each key, segments in order: the window that is open where a segment begins, and the one where it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(STATES)
        owner = None
        out: list[tuple] = []

        def handed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
            out.clear()
            return batch

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                columns = _columns(batch, 7)
                seg = columns[1]
                cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True]) if len(seg) else []
                for low, high in zip(cuts, cuts[1:], strict=False):
                    yield int(columns[0][low]), int(seg[low]), [c[low:high] for c in columns[2:]]

        held, entered = None, False
        for run_id, seg, (at, ms, last, last_ms, windows) in pieces():
            if run_id != owner:
                owner, start, began, no = run_id, 0, int(ms[0]), -1
            if seg != held:
                if len(out) >= 4096:
                    yield handed()
                held, entered = seg, False
                out.append((seg, start, began, no, start, no))
            if entered:
                continue  # a segment's entries may come in two batches
            fit = np.flatnonzero((at - start >= size) & (ms - began >= span)) if no >= 0 else np.array([0])
            if len(fit):
                i, entered = fit[0], True
                start, began, no = int(last[i]), int(last_ms[i]), no + int(windows[i])
                out[-1] = (*out[-1][:4], start, no)
        if out:
            yield handed()

    return run


def _numbered(schema: T.StructType, ms: str, span: float, size: int):
    """``window_no`` of rows sorted by segment and place; each segment begins with the window that is open there.  No row is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        held, start, began, no = None, 0, 0, 0
        for batch in batches:
            seg, at, times, entry = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("_seg", "_at", ms, "_start"))
            window = np.empty(len(seg), np.int64)
            cuts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1], True]) if len(seg) else []
            for low, high in zip(cuts, cuts[1:], strict=False):
                if seg[low] != held:
                    held, start = seg[low], int(entry[low])
                    began, no = (int(batch.column(batch.schema.get_field_index(c))[int(low)].as_py()) for c in ("_began", "_no"))
                    if no < 0:  # the key begins here
                        start, began, no = int(at[low]), times[low], 0
                i = low
                while i < high:
                    close = i + max(0, start + size - int(at[i]))
                    close = high if close >= high else close + int(np.searchsorted(times[close:high], began + span, "left"))
                    window[i:close] = no
                    if close < high:
                        start, began, no = int(at[close]), times[close], no + 1
                    i = close
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f)) for f in arrow.names[:-1]], pa.array(window)], schema=arrow)

    return run


def timed_windows(rows: DataFrame, keys: list[str], order: list[str], ms: str, span: float, size: int, min_tail: int, otherwise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``window_no`` of every row: a window closes before the first row that comes when it has ``size`` rows and ``span`` milliseconds; a tail of fewer than
    ``min_tail`` rows joins the window before it, or is dropped where there is none.

    Keys whose times cannot cut windows have windows of every ``size`` rows.  A window's end depends on its beginning alone, so each block
    tells for its first few rows where windows that open there would leave it; followed from block to block these give the window open at each
    border.  That needs times that never fall along the order; keys where they do go to ``otherwise``.
    """
    blocked = in_blocks(rows, keys, order)
    facts = _segment_facts(blocked, keys, ms)
    own = blocked.join(facts, (F.col("_block") == F.col("_b")) & same(keys)).withColumn("_at", F.col("_in") + F.col("_shift"))
    fixed = own.where(~F.col("_timed")).select(*rows.columns, F.floor(F.col("_at") / size).cast("long").alias("window_no"))
    timed = own.where(F.col("_timed") & F.col("_rising"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thin = timed.select("_seg", "_run", F.col("_at").alias("at"), F.col(ms).alias("ms"))
    entries = write_shared(thin.repartition(parts, "_seg").sortWithinPartitions("_seg", "at").mapInArrow(_entries(span, size), ENTRIES), "window-entries")
    ordered = entries.repartition(parts, "_run").sortWithinPartitions("_run", "at")
    states = write_shared(ordered.mapInArrow(_states(span, size), STATES), "window-states")
    of_run = states.join(facts.select("_seg", "_run", "_total"), F.col("_of") == F.col("_seg")).withColumn("_last_no", F.max("_end_no").over(W.partitionBy("_run"))).withColumn("_last", F.max("_end").over(W.partitionBy("_run")))
    short = F.col("_total") - F.col("_last") < min_tail
    known = of_run.select("_of", "_start", "_began", "_no", "_last_no", short.alias("_short"))
    whole = timed.join(known, F.col("_seg") == F.col("_of")).select(*rows.columns, "_seg", "_at", "_start", "_began", "_no", "_last_no", "_short")
    schema = T.StructType([*rows.schema.fields, T.StructField("_last_no", T.LongType()), T.StructField("_short", T.BooleanType()), T.StructField("window_no", T.LongType())])
    told = whole.repartition(parts, "_seg").sortWithinPartitions("_seg", "_at").mapInArrow(_numbered(schema, ms, span, size), schema)
    tail = F.col("_short") & (F.col("window_no") == F.col("_last_no"))
    numbered = told.where(~(tail & (F.col("_last_no") == 0))).select(*rows.columns, F.when(tail, F.col("window_no") - 1).otherwise(F.col("window_no")).alias("window_no"))
    out = fixed.unionByName(numbered)
    falling = facts.where("_timed AND NOT _rising")
    if falling.limit(1).count():
        out = out.unionByName(otherwise(own.where(F.col("_timed") & ~F.col("_rising")).select(*rows.columns)).select(*rows.columns, "window_no"))
    return out
