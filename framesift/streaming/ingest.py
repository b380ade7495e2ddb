"""Streams: discovery rounds, clips on arriving frames, write-backs and re-deliveries."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framesift.operators.catalog import less_dense, without_siblings
from framesift.plans.shared import shared_path

CLIP = T.StructType([T.StructField("run", T.StringType()), T.StructField("clip_index", T.LongType()), T.StructField("frame_ids", T.ArrayType(T.LongType())), T.StructField("first_ms", T.LongType()), T.StructField("last_ms", T.LongType())])

OPEN = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("first_ms", T.LongType()), T.StructField("last_ms", T.LongType()), T.StructField("next", T.LongType())])
#: Frames read at once from a sorted chunk, and clips handed back at once.
SLICE = 256


def discovery_round(found: DataFrame, manifest: DataFrame, jobs: DataFrame, step: int, most: int, first_run: bool) -> DataFrame:
    """Outcomes of one round over found files (path, dir): ``seed`` on the first run; else new folders less low-resolution
    siblings (skip_8m) and folders covered more densely (manual_dir), and of the rest the first ``most`` (submit, then later)."""
    new = found.join(manifest.select("path"), "path", "left_anti")
    if first_run:
        return new.select("path", "dir", F.lit("seed").alias("outcome"))
    folders = new.select("dir").distinct()
    single = without_siblings(folders)
    open_ = less_dense(single, jobs, step)
    first = open_.orderBy("dir").limit(most).select("dir", F.lit("submit").alias("_o"))
    marked = folders.join(single.select("dir", F.lit(1).alias("_s")), "dir", "left").join(open_.select("dir", F.lit(1).alias("_w")), "dir", "left").join(first, "dir", "left")
    outcome = F.when(F.col("_s").isNull(), "skip_8m").when(F.col("_w").isNull(), "manual_dir").otherwise(F.coalesce("_o", F.lit("later")))
    return new.join(marked.select("dir", outcome.alias("outcome")), "dir").select("path", "dir", "outcome")


def frames_in_order(chunks: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
    """(ms, id) of all chunks by growing time, then id: sorted chunks wait in an unnamed scratch file and are merged in slices."""
    with tempfile.TemporaryFile() as held:

        def read(begin: int, n: int) -> Iterator[tuple[int, int]]:
            for at in range(begin, begin + n, SLICE):
                held.seek(at * 16)
                yield from map(tuple, np.frombuffer(held.read(min(SLICE, begin + n - at) * 16), np.int64).reshape(-1, 2).tolist())

        places, end = [], 0
        for chunk in chunks:
            own = chunk[["ms", "id"]].to_numpy(np.int64)
            held.write(np.ascontiguousarray(own[np.lexsort((own[:, 1], own[:, 0]))]).tobytes())
            places.append((end, len(own)))
            end += len(own)
        yield from heapq.merge(*[read(*p) for p in places])


class ClipCutter(StatefulProcessor):
    """Keeps one open window per run; a frame after a gap, or after a full window, closes it, and so does a timer where
    ``quiet_ms`` is given: a run without frames for so long, by the clock.

    Frames of a run must arrive in order over batches (within a batch they are sorted).
    """

    def __init__(self, gap_ms: int, size: int, least: int, quiet_ms: int | None = None) -> None:
        self.gap_ms, self.size, self.least, self.quiet_ms = gap_ms, size, least, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, first, last, number = self.state.get() if self.state.exists() else ([], None, None, 0)
        ids, out = list(ids), []

        for ms, frame in frames_in_order(rows):
            if ids and (ms - last > self.gap_ms or len(ids) >= self.size):
                if len(ids) >= self.least:
                    out.append((key[0], number, ids, first, last))
                    number += 1
                ids = []
            if not ids:
                first = ms
            ids.append(frame)
            last = ms
            if len(out) >= SLICE:
                yield pd.DataFrame(out, columns=CLIP.names)
                out = []
        self.state.update((ids, first, last, number))
        if self.quiet_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        if out:
            yield pd.DataFrame(out, columns=CLIP.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, first, last, number = self.state.get() if self.state.exists() else ([], None, None, 0)
        long_enough = len(ids) >= self.least
        self.state.update(([], None, None, number + long_enough))
        if long_enough:
            yield pd.DataFrame([(key[0], number, list(ids), first, last)], columns=CLIP.names)

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the RocksDB store; the session's own choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def stream_clips(frames: DataFrame, gap_ms: int, size: int, least: int, quiet_ms: int | None = None) -> DataFrame:
    """Closed clips of a stream of (run, ms, id)."""
    return frames.groupBy("run").transformWithStateInPandas(ClipCutter(gap_ms, size, least, quiet_ms), CLIP, "append", "none" if quiet_ms is None else "processingTime")


def open_clips(spark: SparkSession, checkpoint: str, least: int) -> DataFrame:
    """The windows that ``stream_clips`` left open when its bounded input ended, read from the state in ``checkpoint``."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    clips = state.select("key.run", F.col("value.next").alias("clip_index"), F.col("value.ids").alias("frame_ids"), "value.first_ms", "value.last_ms")
    return clips.where(F.size("frame_ids") >= least)


def last_wins(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in a micro-batch."""
    rest = [c for c in batch.columns if c != key]
    best = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def once_each(stream: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Rows with keys not seen before; with a watermark, state is dropped after it."""
    return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys) if watermark else stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, ts: str, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and type, late rows within ``delay`` included."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now and return the result table: Parquet in the shared folder, a folder for each
    micro-batch, which a repeated batch overwrites.  The last one is the table in complete mode, all of them in append mode.

    ``each`` changes a micro-batch's rows but not their columns, before they are written.  A write-back by ``last_wins`` thus
    appends a batch's last rows only, and one more ``last_wins`` over the table resolves them; no batch rewrites the target.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    done: dict[int, str] = {}

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{path}/{number}")
        done[number] = f"{path}/{number}"

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    folders = [done[max(done)]] if done and mode == "complete" else list(done.values())
    return spark.read.schema(stream.schema).parquet(*folders) if folders else spark.createDataFrame([], stream.schema)
