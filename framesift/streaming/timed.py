"""Keyed state under a watermark: clips cut on arriving frames, sessions, error counts with a time to live, and deliveries once each.

Frames may arrive out of order by as much as the watermark's delay: they wait in state until the watermark has passed them and are then cut in order
of time, so micro-batches and their order make no difference to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TIMED_CLIP = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("run_no", T.LongType()), T.StructField("window_no", T.LongType()), T.StructField("frame_ids", T.ArrayType(T.LongType())),
    T.StructField("first_ms", T.LongType()), T.StructField("last_ms", T.LongType()),
])
FRAMES = T.ArrayType(T.StructType([T.StructField("ms", T.LongType()), T.StructField("id", T.LongType())]))
PENDING = T.StructType([T.StructField("ms", T.LongType()), T.StructField("id", T.LongType())])
#: The run's number and first time, the open window's number and frames, and the window before it while that may still get a short tail.
CUTTING = T.StructType([T.StructField("run_no", T.LongType()), T.StructField("run_first", T.LongType()), T.StructField("window_no", T.LongType()), T.StructField("frames", FRAMES), T.StructField("held", FRAMES)])


class Cutting:
    """The rules of runs and timed windows on frames (ms, id) in order: a run ends after a gap; a window closes before the first frame that comes when it
    has ``size`` frames and ``span`` milliseconds; the window before is held until the open one is no short tail any more."""

    def __init__(self, gap: int, span: float, size: int, min_tail: int, run_no: int = 0, run_first: int | None = None, window_no: int = 0, frames=(), held=()) -> None:
        self.gap, self.span, self.size, self.min_tail = gap, span, size, min_tail
        self.run_no, self.run_first, self.window_no, self.frames, self.held = run_no, run_first, window_no, [tuple(x) for x in frames], [tuple(x) for x in held]

    def _clip(self, number: int, frames: list) -> tuple:
        return self.run_no, number, [i for _, i in frames], frames[0][0], frames[-1][0]

    def add(self, ms: int, frame: int) -> Iterator[tuple]:
        if self.frames and ms - self.frames[-1][0] > self.gap:
            yield from self.end()
        elif len(self.frames) >= self.size and ms - self.frames[0][0] >= self.span:
            if self.held:
                yield self._clip(self.window_no - 1, self.held)
            self.held, self.frames, self.window_no = self.frames, [], self.window_no + 1
        if self.run_first is None:
            self.run_first = ms
        self.frames.append((ms, frame))
        if self.held and len(self.frames) >= self.min_tail:
            yield self._clip(self.window_no - 1, self.held)
            self.held = []

    def end(self) -> Iterator[tuple]:
        """The run is over: its tail joins the window before or is dropped; a run of one point in time has windows of every ``size`` frames."""
        if self.frames and self.run_first == self.frames[-1][0]:
            for n, at in enumerate(range(0, len(self.frames), self.size)):
                yield self._clip(n, self.frames[at : at + self.size])
        elif self.frames and len(self.frames) >= self.min_tail:
            if self.held:
                yield self._clip(self.window_no - 1, self.held)
            yield self._clip(self.window_no, self.frames)
        elif self.held:
            yield self._clip(self.window_no - 1, self.held + self.frames)
        self.run_no, self.run_first, self.window_no, self.frames, self.held = self.run_no + 1, None, 0, [], []

    def state(self) -> tuple:
        return self.run_no, self.run_first, self.window_no, self.frames, self.held


class TimedCutter(StatefulProcessor):
    """``Cutting`` for every run of a stream.  A timer in event time fires when the watermark has passed the first frame that waits, or, where
    none does, the gap after the last one, which ends the run."""

    def __init__(self, gap: int, span: float, size: int, min_tail: int) -> None:
        self.rules = (gap, span, size, min_tail)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getListState("waiting", PENDING), handle.getValueState("cutting", CUTTING)

    def _wake(self, waiting: list[tuple], cutting: Cutting) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [cutting.frames[-1][0] + self.rules[0] + 1] if cutting.frames else []
        if ends or waiting:
            self.handle.registerTimer(min([ms for ms, _ in waiting] + ends))

    def _load(self) -> tuple[list[tuple], Cutting]:
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        return waiting, Cutting(*self.rules, *(self.open.get() if self.open.exists() else ()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, cutting = self._load()
        new = [(int(ms), int(i)) for part in rows for ms, i in zip(part["ms"], part["id"], strict=True)]
        self.waiting.appendList(new)
        self._wake(waiting + new, cutting)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, cutting = self._load()
        clips = [c for ms, i in sorted(x for x in waiting if x[0] <= passed) for c in cutting.add(ms, i)]
        if cutting.frames and cutting.frames[-1][0] + self.rules[0] < passed:
            clips += cutting.end()
        waiting = [x for x in waiting if x[0] > passed]
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        self.open.update(cutting.state())
        self._wake(waiting, cutting)
        if clips:
            yield pd.DataFrame([(key[0], *c) for c in clips], columns=TIMED_CLIP.names)

    def close(self) -> None:
        pass


def stream_timed_clips(frames: DataFrame, gap_ms: int, seconds: float, size: int, min_tail: int, delay: str) -> DataFrame:
    """Clips of a stream of (run, ms, id, ts), ``ts`` being ``ms`` as a timestamp: ``split_runs`` and then ``clip_windows`` of the whole input, run by run
    as the watermark passes their ends.  A row without an id is no frame and only moves the watermark."""
    # one condition that reads the time as well, so that it is not moved below the watermark
    framed = F.when(F.col("ts").isNotNull(), F.col("id").isNotNull()).otherwise(F.lit(False))
    grouped = frames.withWatermark("ts", delay).where(framed).groupBy("run")
    return grouped.transformWithStateInPandas(TimedCutter(gap_ms, seconds * 1000, size, min_tail), TIMED_CLIP, "append", "eventTime")


def session_runs(rows: DataFrame, key: str, ts: str, gap_ms: int, delay: str | None = None) -> DataFrame:
    """(key, n, first_ms, last_ms) of the runs of each key by session windows, for a table and, with ``delay``, for a stream.

    Sessions that touch are one, so rows that are just ``gap_ms`` apart stay together.
    """
    timed = rows.withWatermark(ts, delay) if delay else rows
    sessions = timed.groupBy(key, F.session_window(ts, f"{gap_ms} milliseconds").alias("session"))
    return sessions.agg(F.count("*").alias("n"), F.unix_millis(F.min(ts)).alias("first_ms"), F.unix_millis(F.max(ts)).alias("last_ms")).select(key, "n", "first_ms", "last_ms")


ERRORS = T.StructType([T.StructField("n_errors", T.LongType()), T.StructField("last_at", T.LongType()), T.StructField("last_error", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("heard", T.LongType()), T.StructField("version", T.LongType())])
ERROR_ROWS = T.StructType([T.StructField("clip_id", T.StringType()), T.StructField("n_errors", T.LongType()), T.StructField("last_error", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("decision", T.StringType()), T.StructField("version", T.LongType())])


class ErrorCounter(StatefulProcessor):
    """For each clip the number of failures, the last one's message and whether a valid result came; a clip that nothing was heard of for
    ``ttl_ms`` of event time is forgotten when the watermark passes."""

    def __init__(self, limit: int, ttl_ms: int) -> None:
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.errors = handle.getValueState("errors", ERRORS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, at, message, valid, heard, version = self.errors.get() if self.errors.exists() else (0, None, None, False, 0, 0)
        for part in rows:
            for when, what, good in zip(part["at"].tolist(), part["message"], part["valid"], strict=True):
                valid, heard = bool(valid or good), max(heard, int(when))
                if not good:
                    n += 1
                    at, message = max((at, message), (int(when), what)) if at is not None else (int(when), what)
        self.errors.update((n, at, message, valid, heard, version + 1))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(heard + self.ttl_ms)
        yield pd.DataFrame([(key[0], n, message, valid, "REVIEW" if n >= self.limit and not valid else None, version + 1)], columns=ERROR_ROWS.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.errors.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_error_counts(outcomes: DataFrame, delay: str, limit: int = 3, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """Updates (clip_id, n_errors, last_error, valid, decision, version) of a stream of outcomes (clip_id, at in milliseconds, message, valid, ts); the greatest
    version of a clip is its state, REVIEW at the ``limit``-th failure without a valid result."""
    grouped = outcomes.withWatermark("ts", delay).groupBy("clip_id")
    return grouped.transformWithStateInPandas(ErrorCounter(limit, ttl_ms), ERROR_ROWS, "update", "eventTime")
